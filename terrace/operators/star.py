"""Star-schema builders: date, code and role-playing dimensions, facts and rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import date_key
from terrace.sources.lookups import look_up
from terrace.spec import Measure


def date_dimension(df: DataFrame, column: str) -> DataFrame:
    """One row per date present in ``column``, with calendar attributes. Gaps are not filled.

    Attributes are computed after the distinct, so text formatting runs once per date.
    """
    day = F.col("date")
    return (
        df.select(F.col(column).alias("date"))
        .distinct()
        .select(
            date_key(day).alias("date_key"),
            day,
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.dayofmonth(day).alias("day_of_month"),
            F.dayofweek(day).alias("day_of_week"),
            F.date_format(day, "EEEE").alias("day_name"),
            (F.weekday(day) >= 5).alias("is_weekend"),
        )
    )


def code_dimension(df: DataFrame, code: str, name: str, names: DataFrame) -> DataFrame:
    """Distinct codes with their names; a code without a name is its own name, so that no fact row
    is left without a dimension row."""
    return look_up(df.select(code).distinct(), names, code, name, default=F.col(code))


def role_dimension(df: DataFrame, roles: Sequence[Mapping[str, str]], key: str) -> DataFrame:
    """One row per key found in any role; every attribute is its largest non-NULL value.

    ``roles`` maps output names to input columns, one mapping per role. The roles are expanded in one
    pass over the input. Tuples are counted first because counting groups text in a hash table
    map-side, while ``max`` over text sorts its input, which is then small. (A plain distinct would be
    removed by the optimizer as redundant below ``max``; testing its count keeps it.)
    """
    names = list(roles[0])
    expanded = df.select(
        F.inline(F.array(*[F.struct(*[F.col(role[n]).alias(n) for n in names]) for role in roles]))
    )
    attributes = [n for n in names if n != key]
    tuples = expanded.groupBy(*names).agg(F.count("*").alias("_rows")).filter("_rows > 0")
    return tuples.groupBy(key).agg(*[F.max(a).alias(a) for a in attributes])


def project_fact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The fact projection, as SQL text per column."""
    return df.selectExpr(*columns)


def roll_up(df: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Group and aggregate all measures in one pass; partial aggregation absorbs hot groups."""
    return df.groupBy(*by).agg(*[F.expr(m.sql).alias(m.name) for m in measures])


def with_role(fact: DataFrame, dimension: DataFrame, primary_key: str, foreign_key: str, role: str) -> DataFrame:
    """Join a dimension in one of its roles; its attributes are prefixed with the role name."""
    renamed = dimension.select(
        *[F.col(c).alias(foreign_key if c == primary_key else f"{role}_{c}") for c in dimension.columns]
    )
    return fact.join(renamed, foreign_key)
