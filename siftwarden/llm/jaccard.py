"""Join of documents whose sets of word n-grams are similar, by PartEnum signatures.

Sets are put in bands of size, so that two similar sets are in one band or in neighbours.  In a band
two similar sets differ in at most k elements.  The domain of elements is cut (by a hash) into
``(k + 2) / 2`` groups of two partitions; two sets that differ in at most k elements differ by at most
one in some group, hence agree on one of its two partitions.  The subsets that are enumerated are single
partitions of a group, and their content is the signature: similar sets share one, always.  (Two of three
partitions would be half as many signatures again.)  Sets that share one are verified exactly.

An empty partition would be a signature that all small sets share.  Where all of a group's elements lie in one
partition, the group signs with them, and with them less each one; two such groups that differ by one element share
that.  What then is left are groups of one element or none.  There are ``spare`` groups more than needed, so similar
sets agree (but for one element) in ``spare + 1`` groups, and a set with no more than ``spare`` such groups leaves them
out.  A band in which no element may differ is not signed at all: equal sets are found by their print.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import bit_table, mix, small_batches, stored, tested
from .components import components
from .fingerprints import A, B, C, pair
from .suffix import ranges_of_rows, raw

SLICE = 1 << 20
# groups more than needed: a number, and one in so many
SPARE, SPARE_SHARE = 2, 32
# a print of more rows than this, or than this share of all, is joined by broadcast
HOT_ROWS, HOT_SHARE = 2000, 1e-5
SMALL = 12
BLOCK = 512
# prints or pairs that a task remembers
SEEN = 200_000


def shingle_set(text, words):
    """Sorted distinct fingerprints of the word n-grams of a text (bytes); a shorter text is one n-gram.

    Words are what ASCII white space separates, A-Z lower-cased.
    """
    from xxhash import xxh3_64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    out = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    if len(found) < words:
        whole = np.array([xxh3_64_intdigest(b" ".join(found)), len(found)], dtype=np.uint64)
        return mix(pair(whole[:1], whole[1:]))
    gram = out[:len(out) - words + 1]
    for i in range(1, words):
        gram = pair(gram, out[i:len(out) - words + 1 + i])
    return np.unique(mix(gram))


def upper_bounds(percent):
    """Largest set size of each band: a set of a larger band is similar only to sets of this one or above."""
    out, low = [], 1
    while low < 1 << 40:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array(out)


def signatures(sets, percent):
    """(index of the set, signature) of a list of sets; each takes part in its own band and in the next."""
    bounds = upper_bounds(percent)
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    value, place = mix(element ^ B), mix(element + A)
    rows, out = [], []
    for step in (0, 1):
        band = np.searchsorted(bounds, np.maximum(size, 1)) + step
        # a set too small for the smallest of the next band has no partner there
        fits = (size > 0) & ((step == 0) | (100 * size >= percent * (bounds[band - 1] + 1)))
        differ = np.where(fits, 2 * bounds[band] * (100 - percent) // (100 + percent), 0)
        spare = SPARE + (differ + 2) // 2 // SPARE_SHARE
        groups = np.where(differ > 0, (differ + 2) // 2 + spare, 0)
        base = np.cumsum(groups) - groups
        signed = groups[owner] > 0
        of, worth = owner[signed], value[signed]
        cell = 2 * base[of] + (place[signed] % (2 * groups[of]).astype(np.uint64)).astype(np.int64)
        content, number = np.zeros(2 * groups.sum(), dtype=np.uint64), np.bincount(cell, minlength=2 * groups.sum()).reshape(-1, 2)
        np.add.at(content, cell, worth)
        content = content.reshape(-1, 2)
        row = np.repeat(np.arange(len(sets)), groups)
        tag = ((np.arange(len(row)) - base[row]) * 8 * 4096 + band[row]).astype(np.uint64)
        held, whole = number.sum(axis=1), content.sum(axis=1)

        def add(at, what, kind):
            rows.append(row[at])
            out.append(mix(what * A + (tag[at] + np.uint64(4096 * kind)) * C))

        for side in (0, 1):
            at = np.flatnonzero(number[:, side])
            add(at, content[at, side], side)
        # all elements in one partition: the group itself, and the group less each of its elements
        single = ((number > 0).sum(axis=1) == 1)
        at = np.flatnonzero(single)
        add(at, whole[at], 2)
        inside = single[cell // 2] & (held[cell // 2] > 1)
        at = cell[inside] // 2
        add(at, whole[at] - worth[inside], 2)
        # too many groups of one element or none to do without them
        few = held <= 1
        at = np.flatnonzero(few & (np.bincount(row[few], minlength=len(sets)) > spare)[row])
        add(at, np.zeros(len(at), np.uint64), 3)
    return np.concatenate(rows), np.concatenate(out)


def sets_of(batch, words):
    data, offsets = raw(batch.column("text"))
    view = memoryview(data)
    for a, b in ranges_of_rows(offsets, SLICE):
        yield a, [shingle_set(bytes(view[offsets[i]:offsets[i + 1]]), words) for i in range(a, b)]


def print_of(elements):
    from xxhash import xxh3_128_digest
    return xxh3_128_digest(elements.tobytes())


def sketch_of(elements):
    """Parity of the elements in 2 to 4 buckets per element: as many parities differ as elements, at most."""
    bits = 1 << max(6, int(2 * len(elements) - 1).bit_length())
    odd = np.bincount((mix(elements ^ A) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x, y):
    """Number of parities that differ; the longer sketch is folded to the length of the shorter."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def measure(words):
    """Size, 128-bit print and sketch of each set."""
    def run(batches):
        for batch in batches:
            sizes, prints, sketches = [], [], []
            for _, sets in sets_of(batch, words):
                sizes += [len(s) for s in sets]
                prints += [print_of(s) if len(s) else None for s in sets]
                sketches += [sketch_of(s) if len(s) else None for s in sets]
            yield pa.record_batch({"id": batch.column("id"), "n": pa.array(sizes, pa.int64()),
                                   "print": pa.array(prints, pa.binary()), "sketch": pa.array(sketches, pa.binary())})
    return run


def near_enough(percent):
    """Pairs that may be similar by their sizes and sketches; no similar pair is left out."""
    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            most = (n_a + n_b) * (100 - percent) // (100 + percent)
            fit = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            for i in np.flatnonzero(fit):
                fit[i] = apart(batch.column("sketch_a")[i].as_py(), batch.column("sketch_b")[i].as_py()) <= most[i]
            yield pa.record_batch({c: batch.column(c).filter(pa.array(fit)) for c in ("a", "b")})
    return run


def compare_blocks(percent):
    """Likely pairs between two blocks of a bucket (or inside one), over rows sorted by bucket and blocks.

    Pairs are compared here and not listed: only those that may be similar leave the task.
    """
    def likely_of(rows):
        block, ids, n, component = (rows.column(c).to_numpy() for c in ("block", "id", "n", "component"))
        sketches = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
        size = min(map(len, sketches))
        table = np.array([np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in sketches])
        inside = block[0] == block[-1]
        border = len(block) if inside else np.searchsorted(block, block[-1])
        for i in range(border - inside):
            other = slice(i + 1 if inside else border, None)
            most = (n[i] + n[other]) * (100 - percent) // (100 + percent)
            fit = (component[other] != component[i]) & (np.abs(n[other] - n[i]) <= most)
            near = np.flatnonzero(fit)
            differ = np.bitwise_count(table[other][near] ^ table[i]).sum(axis=1, dtype=np.int64)
            for x in ids[other][near[differ <= most[near]]].tolist():
                yield (min(int(ids[i]), x), max(int(ids[i]), x))

    def run(batches):
        seen, held = set(), None

        def out(pairs):
            return pa.record_batch({"a": pa.array([x for x, _ in pairs], pa.int64()),
                                    "b": pa.array([y for _, y in pairs], pa.int64())})

        def take(rows):
            new = set(likely_of(rows)) - seen
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            return new

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            key = [table.column(c).to_numpy() for c in ("signature", "low", "high")]
            new = np.zeros(len(key[0]) - 1, dtype=bool)
            for k in key:
                new |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            pairs = set()
            for a, b in zip(cuts[:-1], cuts[1:]):
                pairs |= take(table.slice(a, b - a).combine_chunks())
            held = table.slice(cuts[-1])
            yield out(pairs)
        if held is not None:
            yield out(take(held.combine_chunks()))
    return run


def sign(words, percent):
    """Signatures; of equal sets in a task only the first is signed, as long as the prints fit ``SEEN``."""
    def run(batches):
        seen = set()
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            if len(seen) > SEEN:
                seen.clear()
            for a, sets in sets_of(batch, words):
                for i, s in enumerate(sets):
                    key = print_of(s)
                    if key in seen:
                        sets[i] = s[:0]
                    seen.add(key)
                row, signature = signatures(sets, percent)
                if len(row):
                    yield pa.record_batch({"signature": signature.view(np.int64), "id": ids[row + a]})
    return run


def only_in(bits):
    """Documents whose id may be in a table of bits."""
    def run(batches):
        for batch in batches:
            keep = tested(batch.column("hash").to_numpy().view(np.uint64), bits.value)
            yield batch.select(["id", "text"]).take(pa.array(keep))
    return run


def verify(words, percent):
    """Pairs whose sets are similar enough; sets met again in a task are kept."""
    def run(batches):
        sets = {}

        def of(batch, name, i):
            key = batch.column(name)[i].as_py()
            if key not in sets:
                if len(sets) > 256:
                    sets.clear()
                sets[key] = shingle_set(batch.column("text_" + name)[i].as_py(), words)
            return sets[key]

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = of(batch, "a", i), of(batch, "b", i)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({n: batch.column(n).filter(pa.array(keep)) for n in ("a", "b")})
    return run


def similar_documents(docs, words=5, percent=80, id_col="doc_id", text_col="text"):
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their distinct word n-grams.
    No link between different texts is lost; links inside a component that is known already need no
    check of their own.  Null and empty texts have an empty set and link with nothing.  Ids are long;
    rows that share an id are one document and link with each other; rows without an id are measured
    but take no part (null component).  Other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return linked(docs, words, percent, id_col, text_col)


def linked(docs, words, percent, id_col, text_col):
    """What ``similar_documents`` returns; all that goes through Python is stored, none is left to the plan returned."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    measured = stored(docs.mapInArrow(measure(words), "id bigint, n bigint, print binary, sketch binary"), "sets")
    full = measured.filter("n > 0 and id is not null")
    first = stored(full.groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "prints")
    # at most 1 / HOT_SHARE prints are hot
    limit = max(HOT_ROWS, int(HOT_SHARE * (first.agg(F.sum("rows")).first()[0] or 0)))
    hot = F.broadcast(first.filter(F.col("rows") > limit).select("print", "first"))
    rest = full.select("id", "print").join(hot.select("print"), "print", "left_anti").join(
        first.filter(F.col("rows") <= limit).select("print", "first"), "print")
    member = full.select("id", "print").join(hot, "print").unionByName(rest).select("id", "first")
    member = stored(member.distinct(), "members")
    links = member.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))

    # buckets of documents that share a signature, equal sets standing as one
    signed = docs.filter("id is not null").mapInArrow(sign(words, percent), "signature bigint, id bigint")
    crowd = F.count(F.lit(1)).over(Window.partitionBy("signature"))
    buckets = signed.withColumn("crowd", crowd).filter("crowd > 1").drop("crowd")
    buckets = buckets.join(member, "id").select("signature", F.col("first").alias("id")).distinct()
    buckets = stored(buckets.withColumn("crowd", crowd).filter("crowd > 1"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("crowd").alias("degree"))
    sketches = stored(full.select("id", "n", "sketch").join(degree, "id"), "sketches")
    buckets = buckets.join(degree, "id")

    def likely(pairs):
        x = sketches.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        y = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        return stored(pairs.join(y, "b").join(x, "a").mapInArrow(near_enough(percent), "a bigint, b bigint"), "likely")

    def checked(pairs):
        ids = stored(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "ids")
        # most other texts are told apart by a bit table of fixed size, before the exact join shuffles them
        hashed = F.xxhash64("id")
        likely_texts = docs.filter("id is not null").withColumn("hash", hashed).mapInArrow(
            only_in(bit_table(ids.select(hashed.alias("hash")), "hash")), "id bigint, text binary")
        texts = stored(likely_texts.join(ids.hint("shuffle_hash"), "id", "left_semi"), "texts")
        x = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        y = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "text_a", "text_b").mapInArrow(
            verify(words, percent), "a bigint, b bigint")

    # each member against two leaders of its bucket: the one that shares most signatures, and any one
    leaders = buckets.groupBy("signature").agg(
        F.max_by("id", F.struct(F.col("degree"), -F.col("id"))).alias("x"), F.max_by("id", F.xxhash64("id")).alias("y"))
    pairs = buckets.join(leaders, "signature").select(F.explode(F.array("x", "y")).alias("a"), F.col("id").alias("b"))
    pairs = likely(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stored(links.unionAll(checked(pairs)), "found")
    known = components(links)
    # what is left: pairs of a bucket that are still in different components; those of large buckets are
    # compared inside tasks, block against block
    rows = stored(several(buckets.select("signature", "id"), known).withColumn(
        "crowd", F.count(F.lit(1)).over(Window.partitionBy("signature"))), "open")
    small = rows.filter(F.col("crowd") <= SMALL)
    other = small.select("signature", F.col("id").alias("b"), F.col("component").alias("theirs"))
    rest = small.join(other, "signature").filter("id < b and component <> theirs").select(F.col("id").alias("a"), "b")
    rest = likely(rest.distinct().join(pairs, ["a", "b"], "left_anti"))
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    large = rows.filter(F.col("crowd") > SMALL).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "signature", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "id", "component")
    key = ["signature", "low", "high"]
    large = large.join(sketches.select("id", "n", "sketch"), "id").repartition(*key).sortWithinPartitions(*key, "block")
    large = large.mapInArrow(compare_blocks(percent), "a bigint, b bigint").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = stored(rest.unionAll(large).distinct(), "likely")
    if not rest.isEmpty():
        known = components(links.unionAll(checked(rest)))
    known = known.select(F.col("node").alias("id"), "component")
    return measured.select("id", "n").join(known, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def several(buckets, known):
    """Buckets that hold more than one component, with each member's."""
    known = known.select(F.col("node").alias("id"), "component")
    rows = buckets.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(mixed.filter("low < high").select("signature"), "signature")
