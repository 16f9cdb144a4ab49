"""Events from a broker that speaks the Kafka protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The broker's endpoint form and login, and the Kafka client's login class. Some
# platforms repackage the client; they need the class under their own prefix.
ENDPOINT = "{namespace}.servicebus.windows.net:9093"
LOGIN_CLASS = "org.apache.kafka.common.security.plain.PlainLoginModule"
LOGIN_USER = "$ConnectionString"
SHADED_PREFIX = "kafkashaded."


def kafka_options(namespace: str, topic: str, connection_string: str, class_prefix: str = "") -> dict[str, str]:
    """Options for ``readStream.format("kafka")`` against a namespace that takes a connection string
    as password. Starts at the oldest event and tolerates events that expired unread."""
    if '"' in connection_string:
        raise ValueError("a connection string cannot contain a double quote")
    login = f'{class_prefix}{LOGIN_CLASS} required username="{LOGIN_USER}" password="{connection_string}";'
    client = {
        "bootstrap.servers": ENDPOINT.format(namespace=namespace),
        "security.protocol": "SASL_SSL",
        "sasl.mechanism": "PLAIN",
        "sasl.jaas.config": login,
    }
    source = {"subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"}
    return {f"kafka.{name}": value for name, value in client.items()} | source


def records(kafka: DataFrame) -> DataFrame:
    """Broker records as events: text body, broker time, position."""
    return kafka.select(
        F.col("value").cast("string").alias("body"), F.col("timestamp").alias("enqueued_ts"), "partition", "offset"
    )


def kafka_events(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return records(spark.readStream.format("kafka").options(**options).load())
