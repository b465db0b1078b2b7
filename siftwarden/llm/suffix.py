"""Removal of long repeated substrings by distributed prefix doubling.

Every byte position is ranked by the string that starts there, at growing lengths.  Inside a document
ranks are fingerprints, doubled from one byte up to 64; between documents Spark sorts them:

1. Of the strings of ``THRESHOLD`` bytes around it, a position is the *anchor* if the string of ``CORE``
   bytes at it has the smallest rank (about one position in 31).  Equal long strings have their anchor
   at the same place, so only anchors are sorted.  One that is unique drops out.
2. Anchors whose whole surroundings (their *hull*, the union of their long strings) are equal repeat
   each other: all but the first are repeats.
3. Where one core has several hulls, the first anchor of each hull is reranked at the full length,
   string by string.

A byte is removed if a string over it also starts earlier.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mix, stored
from .fingerprints import A, C, doubled, pair, stretch, window_minima

THRESHOLD = 100
CORE = 40
WINDOW = THRESHOLD - CORE + 1
SLICE = 1 << 18
LOCAL_GROUP = 4096
LOW = np.uint64(0xFFFFFF)


def raw(column):
    """Data and offsets of a binary Arrow column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def ranges_of_rows(offsets, limit):
    """Row ranges of about ``limit`` bytes each; a longer row is a range of its own."""
    group = offsets[:-1] // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    return list(zip(cuts[:-1], cuts[1:]))


def anchors(data, ends):
    """Anchors of some texts that stand one after the other: row, first start, number of starts, lead, core, hull.

    The long strings that start at ``first`` to ``first + number - 1`` (counted in the row) share the
    anchor; it lies ``lead`` bytes after the first start.
    """
    starts = np.concatenate([[0], ends[:-1]])
    pieces = []
    # the position is kept in the low bits of a rank, so that a minimum also says where it is
    for at in range(0, max(len(data) - THRESHOLD + 1, 0), int(LOW) - THRESHOLD):
        part = data[at:at + int(LOW)]
        rank = doubled(part, [32, 64])
        cores = pair(rank[32][:32 - CORE], rank[32][CORE - 32:])
        where = window_minima((cores & ~LOW) | np.arange(len(cores), dtype=np.uint64), WINDOW) & LOW
        where = where.astype(np.int64)[:int(LOW) - THRESHOLD]
        row = np.searchsorted(ends, np.arange(at, at + len(where)), "right")
        new = np.ones(len(where), dtype=bool)
        new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        row = row[first]
        last = np.minimum(np.append(first[1:], len(where)) - 1, ends[row] - THRESHOLD - at)
        keep = last >= first
        first, last, row = first[keep], last[keep], row[keep]
        core, lead, number = cores[where[first]], where[first] - first, last - first + 1
        hull = stretch(rank[64], 64, first, number + THRESHOLD - 1)
        hull = mix(hull + lead.astype(np.uint64) * C)
        pieces.append((row, first + at - starts[row], number, lead, core, hull))
    return pieces


def first_of_equal(core, hull, doc, start):
    """True for rows that come after another one of the same core and hull, which is enough to remove them."""
    later = np.zeros(len(core), dtype=bool)
    order = np.argsort(core, kind="stable")
    same = core[order][1:] == core[order][:-1]
    some = np.zeros(len(core), dtype=bool)
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    some = np.flatnonzero(some)
    some = some[np.lexsort((start[some], doc[some], hull[some], core[some]))]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (core[some][1:] != core[some][:-1]) | (hull[some][1:] != hull[some][:-1])
    head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    later[some] = (doc[some] != doc[head]) | (start[some] != start[head])
    return later


ANCHOR = "part bigint, hull bigint, doc bigint, variant int, start int, number int, lead int, kind int"
CANDIDATE, REPEAT, OPEN = 0, 1, 2


def find_anchors(batches):
    """Anchors of each batch; those that already repeat another one of the batch are marked and spread evenly."""
    for batch in batches:
        data, offsets = raw(batch.column(2))
        doc, variant = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = []
        for a, b in ranges_of_rows(offsets, SLICE):
            for row, *rest in anchors(data[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a]):
                found.append((row + a, *rest))
        if not found:
            continue
        row, start, number, lead, core, hull = (np.concatenate(c) for c in zip(*found))
        doc, variant = doc[row], variant[row]
        later = first_of_equal(core, hull, doc, start)
        part = np.where(later, mix(doc.astype(np.uint64) * A + start.astype(np.uint64)), core)
        yield pa.record_batch({
            "part": part.view(np.int64), "hull": hull.view(np.int64), "doc": doc, "variant": variant,
            "start": start.astype(np.int32), "number": number.astype(np.int32), "lead": lead.astype(np.int32),
            "kind": np.where(later, REPEAT, CANDIDATE).astype(np.int32),
        })


def rank_anchors(batches):
    """Over anchors sorted by core, hull and place: repeats, and the first anchors of cores with several hulls."""
    names = ["part", "hull", "doc", "variant", "start", "number", "lead", "kind"]
    held, held_mixed = None, False
    for batch in batches:
        rows = {n: batch.column(n).to_numpy() for n in names}
        through = rows["kind"] == REPEAT
        passed = {n: v[through] for n, v in rows.items()}
        rows = {n: v[~through] for n, v in rows.items()}
        done = np.zeros(len(rows["part"]), dtype=bool)
        if held is not None:
            done = np.concatenate([np.full(len(held["part"]), held_mixed), done])
            rows = {n: np.concatenate([held[n], rows[n]]) for n in names}
        size = len(done)
        if size:
            part, hull, doc, start = (rows[n] for n in ("part", "hull", "doc", "start"))
            new_core, new_hull = np.ones(size, dtype=bool), np.ones(size, dtype=bool)
            new_core[1:] = part[1:] != part[:-1]
            new_hull[1:] = new_core[1:] | (hull[1:] != hull[:-1])
            head = np.maximum.accumulate(np.where(new_hull, np.arange(size), 0))
            later = (doc != doc[head]) | (start != start[head])
            number = np.cumsum(new_core) - 1
            mixed = np.bincount(number[new_hull]) > 1
            mixed[0] |= held is not None and held_mixed
            first = ~later
            first[1:] &= ~((doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & ~new_hull[1:]
                           & (rows["variant"][1:] == rows["variant"][:-1]))
            wanted = first & mixed[number] & ~done
            rows["kind"] = np.where(later, REPEAT, OPEN).astype(np.int32)
            chosen = later | wanted
            last = first & (head == head[-1])
            held, held_mixed = {n: v[last] for n, v in rows.items()}, bool(mixed[-1])
            passed = {n: np.concatenate([passed[n], rows[n][chosen]]) for n in names}
        if len(passed["part"]):
            yield pa.record_batch(passed)


def cut_hulls(batches):
    """The bytes around each open anchor."""
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        spots = batch.column("spots")
        count = spots.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = spots.flatten()
        part, start, number, lead = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        row = np.repeat(np.arange(batch.num_rows), count)
        base = offsets[:-1][row] + start
        size = number.astype(np.int64) + THRESHOLD - 1
        after = np.cumsum(size)
        if not len(after):
            continue
        chars = data[np.repeat(base - after + size, size) + np.arange(after[-1])]
        edges = np.concatenate([[0], after]).astype(np.int32)
        yield pa.record_batch({
            "part": part, "doc": batch.column("doc").to_numpy()[row], "variant": batch.column("variant").to_numpy()[row],
            "start": start, "number": number, "lead": lead,
            "bytes": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(chars)]),
        })


STRING = "part bigint, string bigint, doc bigint, variant int, start int, kind int"


def rank_strings(batches):
    """Over hulls sorted by core: the single strings that repeat an earlier one of the same core.

    Cores with more than ``LOCAL_GROUP`` hulls are left open; their strings are ranked by a shuffle.
    """
    def out(part, string, doc, variant, start, kind):
        return pa.record_batch({
            "part": part.view(np.int64), "string": string.view(np.int64), "doc": doc, "variant": variant,
            "start": start.astype(np.int32), "kind": np.full(len(doc), kind, dtype=np.int32)})

    def close(runs, large):
        if not runs:
            return
        t = pa.Table.from_batches(runs).combine_chunks().to_batches()[0]
        data, offsets = raw(t.column("bytes"))
        number = t.column("number").to_numpy().astype(np.int64)
        after = np.cumsum(number)
        row = np.repeat(np.arange(len(number)), number)
        step = np.arange(after[-1]) - np.repeat(after - number, number)
        rank = doubled(data[offsets[0]:offsets[-1]], [64])[64]
        string = stretch(rank, 64, (offsets[:-1] - offsets[0])[row] + step, np.full(len(row), THRESHOLD))
        string = mix(string + (t.column("lead").to_numpy()[row] - step).astype(np.uint64) * C)
        part, doc, variant = (t.column(n).to_numpy()[row] for n in ("part", "doc", "variant"))
        start = t.column("start").to_numpy()[row] + step
        if large:
            yield out(part, string, doc, variant, start, OPEN)
            return
        later = first_of_equal(part.view(np.uint64), string, doc, start)
        if later.any():
            yield out(part[later], string[later], doc[later], variant[later], start[later], REPEAT)

    complete, current, size, own, last, large = [], [], 0, 0, None, False
    for batch in batches:
        core = batch.column("part").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(core[1:] != core[:-1]) + 1, [len(core)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if core[a] != last:
                complete += current
                current, size, own = [], size + own, 0
                last, large = core[a], False
                if size > LOCAL_GROUP:
                    yield from close(complete, False)
                    complete, size = [], 0
            current.append(batch.slice(a, b - a))
            own += b - a
            if large or own > LOCAL_GROUP:
                yield from close(current, True)
                current, own, large = [], 0, True
    yield from close(complete + current, False)


def keep_rest(batches):
    """Removes the bytes of each text that repeated strings cover."""
    for whole in batches:
        for a, b in ranges_of_rows(raw(whole.column("text"))[1], 4 * SLICE):
            batch = whole.slice(a, b - a)
            data, offsets = raw(batch.column("text"))
            data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
            spans = batch.column("spans")
            count = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = spans.flatten()
            first, number = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            first = np.repeat(offsets[:-1], count) + first
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + number + THRESHOLD - 1, -1)
            gone = np.cumsum(edge, dtype=np.int32)[:-1] > 0
            kept, runs = [], []
            for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:])):
                mask = gone[x:y] if count[i] else np.zeros(0, dtype=bool)
                jump = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]))).tolist()
                kept.append((data[x:y][~mask] if count[i] else data[x:y]).tobytes())
                runs.append([{"start": p, "end": q} for p, q in zip(jump[::2], jump[1::2])])
            yield pa.record_batch({
                "doc": batch.column("id"), "n_bytes": np.diff(offsets),
                "removed": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs, id_col="doc_id", text_col="text"):
    """One row per document: id, ``n_bytes``, ``removed`` (maximal runs of removed bytes) and ``kept`` (binary).

    A string of 100 bytes is a repeat if it also starts at a smaller id (long; null counts as the
    smallest) or earlier in the same document; strings are judged on the input.  Null texts are empty and
    texts under 100 bytes keep all.  Rows that share an id start their strings at equal places, so they
    do not remove each other's; each row is answered.  Other columns are ignored.  Equal strings are
    found by 128 bits of fingerprints.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    docs = docs.withColumn("doc", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("print", F.xxhash64("text"))
    # ids that stand for several texts: usually none
    several = docs.groupBy("doc").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high")
    several = stored(docs.select("doc", "print").join(several.select("doc"), "doc", "left_semi").distinct(), "ids")
    several = several.select("doc", "print", (F.pmod("print", F.lit((1 << 31) - 1)) + 1).cast("int").alias("other"))
    docs = docs.join(several, ["doc", "print"], "left").select(
        "id", "doc", F.coalesce("other", F.lit(0)).alias("variant"), "text")

    found = docs.select("doc", "variant", "text").mapInArrow(find_anchors, ANCHOR)
    ranked = found.repartition("part").sortWithinPartitions("part", "hull", "doc", "start", "variant")
    ranked = stored(ranked.mapInArrow(rank_anchors, ANCHOR), "anchors")

    key = ["doc", "variant"]
    spots = ranked.filter(F.col("kind") == OPEN).groupBy(key).agg(
        F.collect_list(F.struct("part", "start", "number", "lead")).alias("spots"))
    hulls = docs.select(*key, "text").join(spots.hint("shuffle_hash"), key).mapInArrow(
        cut_hulls, "part bigint, doc bigint, variant int, start int, number int, lead int, bytes binary")
    strings = stored(hulls.repartition("part").sortWithinPartitions("part", "doc", "start")
                     .mapInArrow(rank_strings, STRING), "strings")

    large = strings.filter(F.col("kind") == OPEN)
    least = large.groupBy("part", "string").agg(F.min(F.struct("doc", "start")).alias("least"))
    large = large.join(least, ["part", "string"]).filter(F.struct("doc", "start") > F.col("least"))

    one = F.lit(1).alias("number")
    repeats = (ranked.filter(F.col("kind") == REPEAT).select(*key, "start", "number")
               .unionAll(strings.filter(F.col("kind") == REPEAT).select(*key, "start", one))
               .unionAll(large.select(*key, "start", one)))
    repeats = repeats.groupBy(key).agg(F.collect_list(F.struct("start", "number")).alias("spans"))
    kind = "array<struct<start: bigint, end: bigint>>"
    return (docs.join(repeats.hint("shuffle_hash"), key, "left").select("id", "text", "spans")
            .mapInArrow(keep_rest, f"doc bigint, n_bytes bigint, removed {kind}, kept binary")
            .withColumnRenamed("doc", id_col))
