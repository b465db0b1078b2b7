"""Packing, repeated substrings, sharding and token totals against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from .conftest import AWKWARD
from siftwarden.llm import fingerprints, packing, rollup, sharding, suffix
from siftwarden.llm.common import shared_dir
from siftwarden.llm.tokens import Encoder


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_library(library):
    ids, sizes = Encoder().encode(AWKWARD, end_id=0)
    at = 0
    for text, n in zip(AWKWARD, sizes):
        assert ids[at:at + n].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 9)), min_size=1, max_size=14))
def test_best_cuts_are_best(steps):
    at, fine, length = np.cumsum([s for s, _ in steps]), np.array([f for _, f in steps]), 8
    cost = [0] + [None] * len(at)
    places = [0, *at.tolist()]
    for i in range(1, len(places)):
        cost[i] = min(cost[j] + length - (places[i] - places[j]) + int(fine[i - 1])
                      for j in range(i) if places[i] - places[j] <= length)
    cuts = packing.best_cuts(at, fine, length).tolist()
    starts = [0, *cuts[:-1]]
    assert cuts[-1] == at[-1] and all(b - a <= length for a, b in zip(starts, cuts))
    penalty = dict(zip(at.tolist(), fine.tolist()))
    assert sum(length - (b - a) + penalty[b] for a, b in zip(starts, cuts)) == cost[-1]


def packed(rows):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    return by_doc, by_sequence


def test_packing_round_trip(spark, docs, library):
    texts = AWKWARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    by_doc, by_sequence = packed(packing.pack(docs(texts).repartition(3)).collect())
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids, dtype="<u4").tobytes()
        assert all(r.doc_tokens == len(ids) for r in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 1024


def test_packing_keeps_order_and_pads_little(spark):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)).collect()
    order = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    assert list(dict.fromkeys(r.doc_id for r in order)) == sorted({r.doc_id for r in rows})
    sequences = len({r.sequence_id for r in rows})
    assert sum(r.length for r in rows) / (1024 * sequences) > 0.97


def test_packing_of_nothing_and_of_repeated_rows(docs):
    assert packing.pack(docs([])).count() == 0
    twice = docs(["a b c"]).unionAll(docs(["a b c"]))
    assert [(r.doc_id, r.length, r.offset) for r in packing.pack(twice.coalesce(1)).orderBy("offset").collect()] == [(0, 4, 0), (0, 4, 4)]


def brute_repeats(texts):
    """{(id, text): (bytes, runs, kept)} of rows (id, text)."""
    first = {}
    for i, text in texts:
        data = (text or "").encode()
        for s in range(len(data) - 99):
            k = data[s:s + 100]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - 99):
            if first[data[s:s + 100]] < (i, s):
                gone[s:s + 100] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        out.append((i, len(data), list(zip(edges[::2], edges[1::2])), data[:0] + bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out)


def repeats(df):
    return sorted((r.doc_id, r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept)) for r in suffix.remove_repeats(df).collect())


def test_repeats_against_a_plain_loop(docs, words):
    passage = words(60, 1)
    texts = AWKWARD + [words(150, s) for s in range(6)] + [words(40, 50 + s) + " " + passage + " " + words(40, 90 + s) for s in range(12)]
    texts += [texts[-1], texts[-1][:-1] + "!", passage[:99], passage[:100], passage[3:140], "ab" * 400, "ab" * 200 + "c" + "ab" * 300]
    assert repeats(docs(texts).repartition(4)) == brute_repeats(list(enumerate(texts)))


def test_repeats_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert repeats(df) == brute_repeats([(r.doc_id, r.text) for r in df.collect()])


def test_repeats_with_many_hulls_of_one_core(docs, words, monkeypatch):
    monkeypatch.setattr(suffix, "LOCAL_GROUP", 3)
    passage = words(40, 7)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef") for _ in range(60)) + passage + "".join(rng.choice("abcdef") for _ in range(60)) for _ in range(12)]
    assert repeats(docs(texts)) == brute_repeats(list(enumerate(texts)))


def test_repeats_of_rows_that_share_an_id(docs, words):
    a, b = words(80, 1), words(40, 2) + " " + words(80, 1)
    df = docs([a]).unionAll(docs([a])).unionAll(docs([b])).unionAll(docs([a], 5))
    assert repeats(df) == brute_repeats([(0, a), (0, a), (0, b), (5, a)])
    assert suffix.remove_repeats(docs([])).count() == 0


def test_fingerprints_tell_substrings_apart():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=3000)), np.uint8)
    ranks = fingerprints.doubled(data, [32, 64])
    for length in (64, 100, 150, 190):
        at = np.arange(len(data) - length + 1)
        got = fingerprints.stretch(ranks[64], 64, at, np.full(len(at), length))
        assert len(set(got.tolist())) == len({data[i:i + length].tobytes() for i in at})


def plain_ring(rows, shards, virtual, room):
    """The law itself: keys in order, each to the first shard clockwise that has room."""
    at, walks = sharding.ring(shards, virtual)
    room, out = list(room), []
    for place, order, row in sorted(rows, key=lambda r: (r[1], r[2])):
        walk = walks[np.searchsorted(at, np.uint64(place % 2**64)) % len(at)]
        shard = next(s for s in walk if room[s] > 0)
        room[shard] -= 1
        out.append((row, shard))
    return out


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_sharding_is_the_ring(spark, docs, slack, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(sharding, "ROWS", 5)
    df = docs([f"text {i}" for i in range(700)]).unionAll(docs(["same"] * 40).withColumn("doc_id", F.lit(7).cast("long"))).coalesce(1)
    got = sharding.place(df, shards=5, slack=slack, virtual=8).collect()
    keys = df.select(F.xxhash64(F.lit("place"), F.col("doc_id").cast("string")),
                     F.shiftrightunsigned(F.xxhash64(F.lit("order"), F.col("doc_id").cast("string")), 1),
                     F.monotonically_increasing_id(), "doc_id").collect()
    want = plain_ring([tuple(k[:3]) for k in keys], 5, 8, sharding.capacities(len(keys), 5, slack))
    ids = {k[2]: k[3] for k in keys}
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((ids[row], shard) for row, shard in want)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_of_a_hot_id(docs, monkeypatch):
    """A third of the rows under one id: its row numbers are cut by counts, no more than ``ROWS`` rows come one by one."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(sharding, "ROWS", 20)
    monkeypatch.setattr(sharding, "STRETCH_BITS", 4)
    walked, walk = [], sharding.walk_rows

    def counted(rows, filling):
        walked.append(rows.count())
        walk(rows, filling)

    monkeypatch.setattr(sharding, "walk_rows", counted)
    hot = docs([f"copy {i}" for i in range(600)]).withColumn("doc_id", F.lit(7).cast("long")).repartition(3)
    df = docs([f"text {i}" for i in range(900)]).coalesce(1).unionAll(hot)
    got = sharding.place(df, shards=5, virtual=8).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1500 and max(walked, default=0) <= 20
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    # keys before the hot one sit where the plain ring has them
    keys = df.select(F.xxhash64(F.lit("place"), F.col("doc_id").cast("string")),
                     F.shiftrightunsigned(F.xxhash64(F.lit("order"), F.col("doc_id").cast("string")), 1),
                     F.monotonically_increasing_id(), "doc_id").collect()
    want = plain_ring([tuple(k[:3]) for k in keys], 5, 8, sharding.capacities(len(keys), 5, 0.0))
    ids = {k[2]: k[3] for k in keys}
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((ids[row], shard) for row, shard in want)


def test_sharding_of_awkward_rows(docs):
    rows = sharding.place(docs(AWKWARD)).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(AWKWARD)}
    assert len({r.shard for r in rows}) == len(rows) and sharding.place(docs([])).count() == 0


def test_a_new_shard_moves_few_rows(docs):
    df = docs([str(i) for i in range(2000)]).coalesce(1)
    a = {r.doc_id: r.shard for r in sharding.place(df, shards=8, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in sharding.place(df, shards=9, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.45 * len(a)


def change(op, tokens=0, source="s", lang="en", tokenizer="t", old=None):
    o = old or (None, None, None, None)
    return (op, source, lang, tokenizer, tokens, *o)


CHANGES = ("op string, source string, lang string, tokenizer string, tokens long, "
           "old_source string, old_lang string, old_tokenizer string, old_tokens long")


def test_rollup_against_recounting(spark):
    rng, log = random.Random(5), {}
    batches, live = [], {}
    for b in range(4):
        rows = []
        for _ in range(60):
            d, key, n = rng.randrange(40), (rng.choice(["a", "b", None]), rng.choice(["en", None]), "t1"), rng.randrange(50)
            if d not in live:
                rows.append(change("insert", n, *key))
                live[d] = (*key, n)
            elif rng.random() < 0.4:
                rows.append(change("delete", live[d][3], *live.pop(d)[:3]))
            else:
                rows.append(change("revise", n, *key[:2], "t2", old=live[d]))
                live[d] = (*key[:2], "t2", n)
        batches.append(rows)
    totals = rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-test-{rng.random()}")
    for b in (0, 2, 0, 1, 3, 2):
        assert totals.commit(f"b{b}", spark.createDataFrame(batches[b], CHANGES)) is (b not in log)
        log[b] = True
    want = {}
    for s, lang, t, n in live.values():
        docs, tokens = want.get((s, lang, t), (0, 0))
        want[s, lang, t] = (docs + 1, tokens + n)
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in totals.totals().collect()} == want


def test_rollup_ignores_what_was_not_committed(spark):
    totals = rollup.Rollup(spark, f"{shared_dir(spark)}/rollup-crash-{random.random()}")
    one = spark.createDataFrame([change("insert", 5)], CHANGES)
    # a crash after the deltas, then a retry, then two commits of one batch at once
    spark.createDataFrame([("b", "lost", "s", "en", "t", 1, 5)], rollup.DELTA).write.mode("append").parquet(f"{totals.folder}/deltas")
    totals.commit("b", one)
    spark.createDataFrame([("b", "late", 2**62)], rollup.COMMIT).write.mode("append").parquet(f"{totals.folder}/commits")
    spark.createDataFrame([("b", "late", "s", "en", "t", 1, 5)], rollup.DELTA).write.mode("append").parquet(f"{totals.folder}/deltas")
    assert [tuple(r) for r in totals.totals().collect()] == [("s", "en", "t", 1, 5)]
    totals.commit("none", spark.createDataFrame([], CHANGES))
    assert totals.totals().count() == 1
    with pytest.raises(Exception, match="unknown change"):
        totals.commit("bad", spark.createDataFrame([change("upsert", 1)], CHANGES))


def test_token_counts_of_awkward_texts(docs, library):
    rows = rollup.count_tokens(docs(AWKWARD).withColumnRenamed("key", "tokens")).collect()
    assert [r.tokens for r in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in AWKWARD]


def test_query_rollup(spark, library):
    from siftwarden.llm.queries import QUERIES
    want, seen = {}, set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        if hashlib.sha1(r.text.encode()).digest() not in seen:
            seen.add(hashlib.sha1(r.text.encode()).digest())
            docs, tokens = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (docs + 1, tokens + len(library.encode(r.text, add_special_tokens=False).ids))
    got = QUERIES["op5_token_rollup"](spark, SF).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in got} == want and {r.tokenizer for r in got} == {"byte_bpe_50k"}
