"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change is a document's counts with a sign: an insert adds, a delete subtracts, a revision subtracts what was
counted before and adds what counts now. A batch of changes is aggregated to one signed row for each group and
written as one delta folder named by the batch, followed by a commit record of that name. A batch counts once its record
is there, so a batch that died leaves nothing, and one that is committed again is recognised and left as it is. Totals are
maintained: compaction keeps the sums as of some batches, and reading adds the batches committed since.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import map_arrow, slices, stored
from terrace.llm.tokens import WORD_BPE, word_ids
from terrace.sinks import fs

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_bytes")


def counted(docs: DataFrame, tokenizer: str = WORD_BPE, text: str = "text", carry: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """``carry``, tokenizer, n_docs (1), n_tokens, n_bytes (UTF-8) of every row. Null text has none of either."""

    def count(batches):
        encoder = word_ids(tokenizer)
        for batch in slices(batches, "_text"):
            _, n = encoder.encode(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), batch.column("_bytes"), pa.array(n)], names=[*carry, "n_bytes", "n_tokens"]
            )

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in carry) + "n_bytes bigint, n_tokens bigint"
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("_bytes")
    rows = map_arrow(docs.select(*carry, size, F.col(text).alias("_text")), count, schema)
    return rows.select(*carry, F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("bigint").alias("n_docs"), "n_tokens", "n_bytes")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as inserts (1) or deletes (-1)."""
    return counts.select(*GROUP, *((F.col(m) * sign).alias(m) for m in MEASURES))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents counted anew: what they counted before goes, what they count now comes."""
    return signed(before, -1).unionByName(signed(after, 1))


def _sums() -> list[Column]:
    return [F.sum(m).cast("bigint").alias(m) for m in MEASURES]


@dataclass(frozen=True)
class Rollup:
    """One rollup below a folder that all executors share."""

    spark: SparkSession
    root: str

    def _folder(self, batch: str) -> str:
        return f"{self.root.rstrip('/')}/batch={batch}"

    def _record(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/_commits/{name}.json"

    def _records(self, kind: str) -> list[str]:
        names = fs.children(self.spark, f"{self.root.rstrip('/')}/_commits")
        return sorted(n.removeprefix(f"{kind}-").removesuffix(".json") for n in names if n.startswith(f"{kind}-") and n.endswith(".json"))

    def committed(self, batch: str) -> bool:
        return fs.exists(self.spark, self._record(f"batch-{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed counts. False if this batch was committed before; nothing changes then. An
        unfinished attempt of the same batch is overwritten: a batch counts from the moment its own record is written, whatever
        files Spark's committer leaves. One writer at a time commits a given batch."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*GROUP).agg(*_sums())  # combined in each task before the shuffle
        sums.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self._folder(batch))
        fs.write_text_once(self.spark, self._record(f"batch-{batch}"), json.dumps({"batch": batch}))
        return True

    def _base(self) -> tuple[list[str], set[str], int]:
        """Folder of the latest totals, the batches in them, and their number."""
        numbers = self._records("total")
        if not numbers:
            return [], set(), 0
        held = json.loads(fs.read_text(self.spark, self._record(f"total-{numbers[-1]}")))
        return [held["folder"]], set(held["batches"]), int(numbers[-1])

    def totals(self) -> DataFrame:
        """Current sums of every group: the totals kept last and the batches committed since. Groups that are back at nothing are left out."""
        base, held, _ = self._base()
        found = base + [self._folder(b) for b in self._records("batch") if b not in held]
        kinds = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint"
        rows = self.spark.read.schema(kinds).parquet(*found) if found else self.spark.createDataFrame([], kinds)
        return rows.groupBy(*GROUP).agg(*_sums()).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> None:
        """Keep the totals as of now, so that later reads begin with them: cost follows the batches since, not all there ever were."""
        base, held, number = self._base()
        batches = self._records("batch")
        if set(batches) == held:
            return
        folder = f"{self.root.rstrip('/')}/total={number + 1:08d}-{uuid.uuid4().hex}"
        self.totals().write.parquet(folder)
        fs.write_text_once(self.spark, self._record(f"total-{number + 1:08d}"), json.dumps({"folder": folder, "batches": batches}))


def counts_after_cleaning(docs: DataFrame, rollup: Rollup, tokenizer: str = WORD_BPE) -> DataFrame:
    """The life of a corpus in three commits: every document is inserted; documents with repeated lines are
    revised to their distinct lines; copies of a text (all but the least id) are deleted. The deletion is committed
    twice, as after a lost acknowledgement, and counts once.

    Result: source, lang, tokenizer, n_docs, n_tokens, n_bytes. Null sources and languages are groups of their
    own, null texts count as documents without tokens, repeated rows are copies, an empty table gives no groups.
    """
    fold = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    rows = docs.select("doc_id", "source", "lang", "text", fold.alias("folded"))
    rows = rows.withColumn("changed", F.coalesce(F.col("text") != F.col("folded"), F.lit(False)))
    rows = rows.withColumn("row", F.xxhash64("text", "doc_id"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("folded", F.lit("")), 256))
    carry = ("doc_id", "source", "lang", "changed", "row", "digest")
    before = stored(counted(rows, tokenizer, carry=carry), "token-counts")  # every text is tokenized once
    after = stored(counted(rows.where("changed"), tokenizer, "folded", carry), "token-counts")
    rollup.commit("insert", signed(before, 1))
    rollup.commit("revise", revised(before.where("changed"), after))
    now = before.where("not changed").unionByName(after)
    # copies are alike: a group holds n times one copy's counts, and the group of the least id keeps one of them
    firsts = now.groupBy("digest", *GROUP).agg(
        F.min(F.struct("doc_id", "row")).alias("one"), *_sums(), F.max("n_tokens").alias("t"), F.max("n_bytes").alias("b")
    )
    keeper = firsts.groupBy("digest").agg(F.min(F.struct("one", *GROUP)).alias("g"))
    own = F.struct("one", *GROUP).eqNullSafe(F.col("g"))
    extra = firsts.join(keeper, "digest").withColumn("stays", F.when(own, 1).otherwise(0))
    gone = extra.select(
        *GROUP,
        (F.col("n_docs") - F.col("stays")).alias("n_docs"),
        (F.col("n_tokens") - F.col("stays") * F.col("t")).alias("n_tokens"),
        (F.col("n_bytes") - F.col("stays") * F.col("b")).alias("n_bytes"),
    )
    for _ in range(2):
        rollup.commit("drop-copies", signed(gone, -1))
    rollup.compact()
    return rollup.totals()
