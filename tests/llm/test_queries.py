"""Registered queries: schemas that are fixed, and the SQL twins."""

import hashlib
import zlib

import numpy as np
import pytest

import __spark_entry__
from conftest import SF
from .test_records import brute_neighbours, library_tokens, plain_spans  # noqa: F401
from siftwarden.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_nearest": "query_id rank vec_id score",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_jaccard_join": "doc_id n_shingles component_id",
    "op4_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op5_token_rollup": "source lang tokenizer docs tokens",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_decontamination": "doc_id item_id score first_word end_word",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_mixing": "doc_id size source_size target taken",
    "op13_lexical_search": "item_id rank doc_id score",
}


def test_all_registered():
    assert set(COLUMNS) == set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert QUERIES[name](spark, SF).columns == COLUMNS[name].split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1_scores_and_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute_neighbours(rows, 20), {}
    for r in sorted(result(spark, "op1_nearest"), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    vectors = {i: np.array(v, dtype=float) for i, v in rows if v}
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, len(want[q]) + 1))
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-9 for v, s, _ in found)
        assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in zip(found, found[1:]))
    hits = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_op2_held_out_and_languages(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = result(spark, "op2_language_id")
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    assert {r.lang_pred for r in rows} <= {x for x in langs.values() if x} | {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id]))) for r in rows)
    told = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(told) > 0.95 * len(told) > 0


def test_op6_sizes_and_shards(spark, texts):
    rows = result(spark, "op6_sharding")
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values()) and {r.law for r in rows} == {"rows"}
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and {r.grown_shard for r in rows} == {None}


def test_op7_counts_and_digests(spark, texts):
    rows = {r.doc_id: r for r in result(spark, "op7_pii")}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        base, r = plain_spans(t), rows[i]
        assert [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        told = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == told


def test_op9_pieces_hold_every_id(spark, texts, library_tokens):  # noqa: F811
    rows, own, fill = result(spark, "op9_packing"), {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert own.keys() == texts.keys()
    for i, pieces in own.items():
        ids = np.array([*library_tokens.encode(texts[i], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(n for parts in fill.values() for _, n in parts) > 0.95 * 1024 * len(fill)


def test_op10_removals(spark, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        gone = np.zeros(len(data) + 1, dtype=np.int8)
        for k in range(len(data) - 99):
            part = data[k:k + 100]
            if part in seen:
                gone[k:k + 100] = 1
            seen.add(part)
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, "op10_suffix_dedup")} == want
