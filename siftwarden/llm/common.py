"""Helpers of the training-data operators: shared storage, process-wide caches, batch slicing, hashes."""

import contextlib
import sys
import tempfile
import types
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
BITS = 24


def shared_dir(spark):
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df, name):
    """Write an intermediate to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark, limit=SLICE_BYTES):
    """While this holds, rows go to Python in Arrow batches of about ``limit`` bytes (a longer row alone).

    By default batches have 10,000 rows, so their buffers, in the JVM and in Python, are as large as the texts are long.
    Only what runs meanwhile is affected; a limit of the session that is smaller stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own, most = spark.conf.get(name), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    spark.conf.set(name, str(min(limit, most) if most > 0 else limit))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def process_cache():
    """A dict that lives as long as the Python worker, for models that are costly to load."""
    return sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__


def slices(batches, column, limit=SLICE_BYTES):
    """Cut Arrow batches into slices of about ``limit`` bytes of one column; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x):
    """Scramble 64-bit values (numpy, wraps around)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bit_table(rows, column):
    """A table of 2^24 bits with those of a long column's values set, broadcast.

    The bits are put together in Spark, 64 a row, so at most 2^18 numbers come to the driver.  The size of the
    table does not depend on the number of values; with very many it only lets more pass.
    """
    low = F.col(column).bitwiseAND((1 << BITS) - 1)
    words = rows.groupBy(F.shiftright(low, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def tested(values, bits):
    """Places of the values (unsigned) whose bit is set in the table."""
    word = (values & np.uint64((1 << BITS) - 1)) >> np.uint64(6)
    return np.flatnonzero(bits[word.astype(np.int64)] >> (values & np.uint64(63)) & np.uint64(1))


def possible(rows, column, keys):
    """A condition on ``rows``: the long column may be among the ``keys`` (a column of that name); it never misses one."""
    bits = bit_table(keys, column)

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), dtype=bool)
        out[tested(values.to_numpy().view(np.uint64), bits.value)] = True
        return pd.Series(out)
    return held(F.col(column))
