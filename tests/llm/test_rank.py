"""Conversation repair, source mixing and lexical search against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm.conftest import AWKWARD
from siftwarden.llm import mixing, repair, search

WHITE = " \t\n\x0b\x0c\r"
FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
TURN_COLUMNS = "conv_id long, turn long, role string, text string, conv string, at int, row string, codes double"


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of one conversation's rows, by trying all edits."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    # cheapest (cost, audit, repaired) on the way to each state, by the last initial
    best = {"": (0, "", ())}

    def better(table, state, found):
        if state not in table or found[:2] < table[state][:2]:
            table[state] = found

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, out) in list(table.items()):
                new = "a" if state == "u" else "u"
                better(table, new, (cost + 5, audit + "I", (*out, {"u": "user", "a": "assistant"}[new] + ":")))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults):
        after, more = {}, 5 * (fault == "truncated")
        for state, (cost, audit, out) in best.items():
            better(after, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            if kept := FOLLOW.get((state, role[:1])):
                better(after, kept, (cost + more, audit + "K", (*out, f"{role}:{text}")))
            new = "a" if state == "u" else "u"
            better(after, new, (cost + 1 + more, audit + "R", (*out, f"{'assistant' if new == 'a' else 'user'}:{text}")))
        best = inserted(after)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, "\n".join(out))


def random_turns(seed, conversations, longest):
    rng = random.Random(seed)
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "System"])
            text = rng.choice(["Well.", "Yes!", "Why?", "cut", "cut ", "", " \t", None, "a\nb.", "é.", "ok. \n", f"n{turn}.", f"n{turn}."])
            yield conv if conv else None, rng.choice([turn, turn, turn, None, turn // 2]), role, text


def repaired(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 1, "y", 2.0) for r in rows], TURN_COLUMNS)
    return {r.conv_id: r for r in repair.repair(table, **more).collect()}


def check(found, rows):
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(row)
    assert set(found) == set(groups)
    for conv, own in groups.items():
        *want, text = plain_repair(own)
        got = found[conv]
        assert [got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit] == want, (conv, own)
        assert "\n".join(f"{t.role}:{t.text}" for t in got.repaired) == text
        assert got.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repair_is_the_cheapest(spark):
    rows = list(random_turns(1, 300, 14))
    check(repaired(spark, rows), rows)


@pytest.mark.parametrize("stretch", [1, 2, 5])
def test_repair_over_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH_ROWS", stretch)
    rows = list(random_turns(stretch, 40, 30))
    check(repaired(spark, rows), rows)


def test_repair_of_one_large_conversation(spark):
    """A third of the rows and more in one conversation, many equal; it is cut over tasks."""
    rng = random.Random(4)
    rows = [(7, i // 2, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"t{i}.", "cut", ""])) for i in range(9000)]
    rows += [(7, 50, "user", "Same.")] * 500 + list(random_turns(5, 100, 6))
    check(repaired(spark, rows), rows)


def test_repair_lists_conversations_without_rows(spark):
    rows = [(1, 0, "user", "Gone."), (2, 0, "user", "Here."), (2, 1, "assistant", "Gone.")]
    found = repaired(spark, rows, gone=F.col("text") == "Gone.", texts=False)
    assert found[1][1:9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2].audit == "D" and found[2].cost == 2
    assert not repaired(spark, [])


def test_ranks_are_the_order_of_audits():
    """Ranks by doubled pointers sort nodes as their audit strings do."""
    import numpy as np
    rng = random.Random(9)
    codes = [bytes(rng.choice([0, 1, 2, 3, 4, 9, 17, 18, 1, 2]) for _ in range(rng.randrange(0, 20))) for _ in range(50)]
    graph = repair.Graph(codes, np.broadcast_to(np.array(repair.END_COSTS)[:, None], (50, 4, 1)))
    graph.rank()
    audits = {}
    for node in range(len(graph.letter)):
        at, text = node, b""
        while graph.letter[at]:
            text, at = text + graph.letter[at:at + 1].tobytes(), graph.pointers[0][at]
        audits[node] = text
    ordered = sorted(set(audits.values()))
    assert [ordered.index(audits[n]) for n in range(len(graph.letter))] == graph.ranks.tolist()


def plain_mix(rows, weights, cap, share=1.0):
    """Target and taken words of each source, filling up by weight round after round."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(rf"[^{WHITE}]+", text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(size.values())
    while free and left > 1e-9:
        total, more = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= cap * size[s]:
                more += target[s] - cap * size[s]
                target[s] = cap * size[s]
                free.discard(s)
        left = more
    return size, target


def mixed(spark, rows, **more):
    table = spark.createDataFrame([(i, t, s, 1, "x", 2, 3.0) for i, t, s in rows],
                                  "doc_id long, text string, source string, size int, row string, place int, target double")
    return mixing.mix_sources(table, keep=("source",), **more)


def check_mix(rows, found, weights=(5, 2, 1), cap=3, share=1.0):
    size, target = plain_mix(rows, weights, cap, share)
    taken = Counter()
    for r in found:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= cap * r.size
        taken[r.source] += r.taken
    assert len(found) == len(rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= 1.001, s
        # all but one document are taken whole, some number of times
        assert sum(r.size > 0 and r.taken % r.size > 0 for r in found if r.source == s) <= 1


def test_mix_meets_targets(spark, words, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rng = random.Random(2)
    rows = [(i, words(rng.choice([1, 3, 30, 300]), i), rng.choice(["web", "web", "web", "code", "book", "é", "", None])) for i in range(900)]
    first = mixed(spark, rows).collect()
    check_mix(rows, first)
    assert sorted(first, key=str) == sorted(mixed(spark, rows[::-1]).collect(), key=str)
    check_mix(rows, mixed(spark, rows, weights=(1, 1), cap=1, share=0.4).collect(), (1, 1), 1, 0.4)


def test_mix_of_hot_and_repeated_rows(spark, monkeypatch):
    """A third of the rows are equal: how many of them are taken is exact."""
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    rows = [(5, "one two three", "a")] * 400 + [(None, "x", "a")] * 300 + [(i, "w " * (i % 7), "b") for i in range(400)]
    found = mixed(spark, rows, weights=(1, 6)).collect()
    check_mix(rows, found, (1, 6))
    assert sorted(map(str, found)) == sorted(map(str, mixed(spark, rows, weights=(1, 6)).collect()))


def test_mix_of_awkward_texts(spark):
    check_mix(rows := [(i, t, None) for i, t in enumerate(AWKWARD)], mixed(spark, rows).collect())
    assert mixed(spark, []).count() == 0
    assert [r.taken for r in mixed(spark, [(1, None, "a"), (2, " ", None)]).collect()] == [0, 0]


def test_mixes_are_nested(spark, words):
    rows = [(i, words(20 + i % 9, i), "ab"[i % 2]) for i in range(200)]
    small, large = ({r.doc_id: r.taken for r in mixed(spark, rows, weights=(1,), cap=1, share=s).collect()} for s in (0.3, 0.6))
    assert sum(small.values()) < sum(large.values()) and all(small[i] <= large[i] for i in small)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in terms}
        found = []
        for (doc, c), n in zip(held, sizes):
            m = 50 + (50 * n * total) // max(length, 1)
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items())
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in docs], "doc_id long, text string, id string, rank int, score double")
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, doc_id int")
    return sorted((tuple(r) for r in search.search(d, q, k=k).collect()), key=str)


@pytest.mark.parametrize("chunk, k", [(16, 5), (1 << 13, 50)])
def test_search_against_plain_scores(spark, words, monkeypatch, chunk, k):
    monkeypatch.setattr(search, "CHUNK_DOCS", chunk)
    rng = random.Random(6)
    docs = [(i, words(rng.choice([3, 20, 200]), i, 120)) for i in range(300)] + [(i, words(40, 1, 120)) for i in range(300, 380)]
    items = [(i, words(rng.choice([1, 8, 90]), i + 5, 130)) for i in range(30)]
    assert searched(spark, docs, items, k) == plain_search(docs, items, k)


def test_search_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "PIECE", 64)
    docs = list(enumerate(AWKWARD)) + [(None, "one two"), (3, "one"), (3, "one"), (90, "ONE\x00two/three_é"), (91, "日本 two")]
    items = [(1, "one Two"), (1, "three"), (2, None), (3, ""), (4, "nowhere"), (None, "é one"), (5, "日本 日本 one"), (5, "日本 日本 one")]
    assert searched(spark, docs, items, 4) == plain_search(docs, items, 4)
    assert searched(spark, docs, [], 4) == searched(spark, [], items, 4) == []


def test_search_in_blocks_of_items(spark, words, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    docs = [(i, words(30, i, 60)) for i in range(60)]
    items = [(i, words(12, 100 + i, 60)) for i in range(12)]
    assert searched(spark, docs, items, 7) == plain_search(docs, items, 7)
