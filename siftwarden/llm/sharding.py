"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key belongs to the next virtual node clockwise.  Keys come in the order of a second hash; one whose
shard is full goes on clockwise to the next shard with room.  The outcome depends on when each shard
gets full, so only these few moments are searched for: counts by arc and order bucket are summed in
Spark and walked on the driver, and a bucket in which a shard fills is looked at more closely, down to
single keys.  Where many rows share one key, their row numbers are cut into buckets in the same way.  What
comes to the driver at a time is bounded (arcs times buckets, or ``ROWS`` keys), whatever one key holds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stored

DIGIT, DIGITS = 9, 7  # the order is a number of 63 bits
ROWS = 4096
STRETCH_BITS = 20


def ring(shards, virtual):
    """Positions of the virtual nodes, ascending, and the shards in the order they follow each arc clockwise."""
    from xxhash import xxh3_64_intdigest

    nodes = sorted((xxh3_64_intdigest(f"{shard}/{v}".encode()), shard) for shard in range(shards) for v in range(virtual))
    owners = [shard for _, shard in nodes]
    walks = []
    for i in range(len(nodes)):
        walks.append(list(dict.fromkeys(owners[i:] + owners[:i])))
    return np.array([at for at, _ in nodes], dtype=np.uint64), np.array(walks)


class Filling:
    """Loads of the shards while keys come in; ``turns`` are the moments at which a shard was full."""

    def __init__(self, walks, room):
        self.walks, self.room, self.turns = walks, np.array(room), []
        self.aim()

    def aim(self):
        """Where each arc's keys go now: the first shard of its walk that has room."""
        free = self.room[self.walks] > 0
        self.target = self.walks[np.arange(len(self.walks)), np.argmax(free, axis=1)]

    def take(self, counts, after):
        """Keys per arc that all come before ``after``; False, and nothing taken, if a shard overflows."""
        each = np.bincount(self.target, weights=counts, minlength=len(self.room)).astype(np.int64)
        if (each > self.room).any():
            return False
        self.room = self.room - each
        if ((self.room == 0) & (each > 0)).any():
            self.aim()
            self.turns.append((after, self.target.copy()))
        return True


def capacities(keys, shards, slack):
    if slack:
        return [int(np.ceil(keys * (1 + slack) / shards))] * shards
    return [keys // shards + (s < keys % shards) for s in range(shards)]


def fill(keyed, filling, low=0, digit=0):
    """Walk the keys whose order begins like ``low`` (its first ``digit`` digits)."""
    width = 63 - DIGIT * digit
    part = keyed.filter((F.col("order") >= low) & (F.col("order") <= low + (1 << width) - 1))
    if digit == DIGITS:
        # one order value: its rows are told apart by their numbers
        first, last, number = part.agg(F.min("row"), F.max("row"), F.count(F.lit(1))).first()
        if number <= ROWS:
            walk_rows(part, filling)
        else:
            fill_rows(part, filling, low, first, last)
        return
    step = width - DIGIT
    counts = part.groupBy("arc", F.shiftright(F.col("order") - low, step).cast("int").alias("bucket")).count().toPandas()
    arcs = len(filling.walks)
    table = np.zeros((1 << DIGIT, arcs), dtype=np.int64)
    table[counts["bucket"], counts["arc"]] = counts["count"]
    for bucket in np.flatnonzero(table.sum(axis=1)).tolist():
        start = low + (bucket << step)
        if filling.take(table[bucket], (start + (1 << step), 0)):
            continue
        if table[bucket].sum() <= ROWS:
            walk_rows(part.filter((F.col("order") >= start) & (F.col("order") <= start + (1 << step) - 1)), filling)
        else:
            fill(keyed, filling, start, digit + 1)


def fill_rows(rows, filling, order, first, last):
    """Walk the rows of one order value whose numbers lie between ``first`` and ``last``."""
    step = (last - first) // (1 << DIGIT) + 1
    part = rows.filter((F.col("row") >= first) & (F.col("row") <= last))
    counts = part.groupBy("arc", F.expr(f"cast((row - {first}) div {step} as int)").alias("bucket")).count().toPandas()
    table = np.zeros((1 << DIGIT, len(filling.walks)), dtype=np.int64)
    table[counts["bucket"], counts["arc"]] = counts["count"]
    for bucket in np.flatnonzero(table.sum(axis=1)).tolist():
        start = first + bucket * step
        if not filling.take(table[bucket], (order, start + step)):
            fill_rows(rows, filling, order, start, start + step - 1)


def walk_rows(rows, filling):
    one = np.zeros(len(filling.walks), dtype=np.int64)
    for r in rows.select("arc", "order", "row").orderBy("order", "row").toLocalIterator():
        one[r.arc] = 1
        filling.take(one, (r.order, r.row + 1))
        one[r.arc] = 0


def place(docs, shards=16, slack=0.0, virtual=32, id_col="doc_id", text_col="text"):
    """One row per document: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot``.

    No shard gets more than ``(1 + slack)`` times its share of the rows; with no slack, counts differ
    by one at most.  Slots count from 0 in a shard without gaps.  Null texts are empty; rows that share
    an id, or have none, sit at the same place of the ring and are placed each; other columns are ignored.
    """
    at, walks = ring(shards, virtual)
    hashed = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.lit("place"), F.col(id_col).cast("string")).alias("place"),
        F.shiftrightunsigned(F.xxhash64(F.lit("order"), F.col(id_col).cast("string")), 1).alias("order"),
        F.monotonically_increasing_id().alias("row"))

    def arcs(batches):
        for batch in batches:
            place = batch.column("place").to_numpy().view(np.uint64)
            arc = (np.searchsorted(at, place) % len(at)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(arc)], names=[*names, "arc"])

    names = ["id", "bytes", "text_crc32", "order", "row"]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, bytes bigint, text_crc32 bigint, order bigint, row bigint"
    # row numbers are only fixed once the table is written
    keyed = stored(hashed.mapInArrow(arcs, schema + ", arc int"), "keyed")
    filling = Filling(walks, capacities(keyed.count(), shards, slack))
    first = filling.target.copy()
    fill(keyed, filling)
    turns = [(-1, 0, first), *((o, r, t) for (o, r), t in filling.turns)]

    def assign(batches):
        for batch in batches:
            order, row, arc = (batch.column(c).to_numpy() for c in ("order", "row", "arc"))
            shard = np.zeros(len(arc), dtype=np.int32)
            for o, r, target in turns:
                later = (order > o) | ((order == o) & (row >= r))
                shard[later] = target[arc[later]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shard)], names=[*names, "shard"])

    # rows of a task have numbers in a row, so a stretch is a million of them at most, whatever their ids
    placed = keyed.mapInArrow(assign, schema + ", shard int").withColumn("stretch", F.shiftright("row", STRETCH_BITS))
    inside = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("row")) - 1
    sizes = placed.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = placed.withColumn("inside", inside).join(sizes.select("shard", "stretch", before.alias("before")), ["shard", "stretch"])
    return placed.select(F.col("id").alias(id_col), (F.col("bytes") + 1).alias("size"), "text_crc32", "shard",
                         (F.col("before") + F.col("inside")).cast("long").alias("slot"))
