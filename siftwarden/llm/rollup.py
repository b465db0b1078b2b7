"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A rollup lives in a folder of the shared store: ``deltas`` holds the signed sums of each attempt at a
batch, ``commits`` one row per finished attempt.  A batch counts through its first commit only, so one
that is repeated, retried after a crash, or run twice at once changes nothing.  Totals are sums of
deltas, so batches may come in any order, and no document is ever looked up again.
"""

import time
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer")
DELTA = "batch string, attempt string, source string, lang string, tokenizer string, docs bigint, tokens bigint"
COMMIT = "batch string, attempt string, at bigint"


def count_tokens(docs, tokenizer=None, name="byte_bpe_50k", text_col="text"):
    """The input with ``tokenizer`` (its version) and ``tokens`` of the whole text; a null text has none.

    Columns of the input with these names are replaced.
    """
    docs = docs.drop("tokenizer", "tokens")
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches):
        bpe = encoder(tokenizer)
        for part in slices(batches, at):
            tokens = [len(bpe.ids(t)) if t else 0 for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tokens, pa.int64())], names=[*columns, "tokens"])

    from pyspark.sql.types import LongType, StructField, StructType
    counted = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("tokens", LongType())]))
    return counted.withColumn("tokenizer", F.lit(name))


def signed(changes):
    """Signed rows of a table of changes with ``op``, the keys, ``tokens`` and, for revisions, the old ones.

    ``insert`` adds, ``delete`` takes away, ``revise`` takes ``old_source, old_lang, old_tokenizer,
    old_tokens`` away and adds the new ones.  Null tokens are none; another ``op`` is an error.
    """
    new = [*(F.col(k).cast("string").alias(k) for k in KEYS), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")]
    old = ([*(F.col(f"old_{k}").cast("string").alias(k) for k in KEYS),
            F.coalesce("old_tokens", F.lit(0)).cast("long").alias("tokens")] if "old_tokens" in changes.columns else None)
    one, less = F.lit(1).cast("long").alias("docs"), F.lit(-1).cast("long").alias("docs")
    add, take = F.struct(one, *new), F.struct(less, *new)
    parts = (F.when(F.col("op") == "insert", F.array(add)).when(F.col("op") == "delete", F.array(take)))
    if old is not None:
        parts = parts.when(F.col("op") == "revise", F.array(F.struct(less, *old), add))
    parts = parts.otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    return changes.select(F.inline(parts))


class Rollup:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder.rstrip("/")

        for name, schema in (("deltas", DELTA), ("commits", COMMIT)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")

    def table(self, name, schema):
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def commit(self, batch, changes):
        """Apply a batch of changes once; returns False if it had been applied before."""
        if not self.table("commits", COMMIT).filter(F.col("batch") == batch).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        # summed before and after the shuffle, so a hot source moves one row per task
        delta = signed(changes).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("tokens")).alias("tokens"))
        delta.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), *KEYS, "docs", "tokens").write.mode(
            "append").parquet(f"{self.folder}/deltas")
        self.spark.createDataFrame([(batch, attempt, time.time_ns())], COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.folder}/commits")
        return True

    def totals(self):
        """(source, lang, tokenizer, docs, tokens) of all committed batches; groups that came to nothing are left out."""
        first = self.table("commits", COMMIT).groupBy("batch").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))
        deltas = self.table("deltas", DELTA).join(first, ["batch", "attempt"], "left_semi")
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")
