"""Neighbours, languages, similar documents, chats, personal data and benchmark leaks against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from .conftest import AWKWARD
from siftwarden.llm import ann, chat, decontam, jaccard, langid, pii
from siftwarden.llm.common import SLICE_BYTES
from siftwarden.llm.components import components

SEPARATE = re.compile(r"[^\x20\x09-\x0D]+")


# --- neighbours --------------------------------------------------------------------------------
def brute_neighbours(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-float(w @ v), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def neighbours(df, k=20):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def recall(got, want):
    hits = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in near}) for i, near in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 64)
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = neighbours(df)
    assert recall(got, want) >= 0.9
    for i, near in got.items():
        assert all(abs(s - dict(want[i]).get(j, s)) < 1e-9 for j, s in near) and near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_neighbours_of_awkward_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(45)]
    same = [1.0, 2.0, 0.5, -1.0]
    rows += [(100 + i, same) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 4), (63, [1.0, None, 0.0, 2.0]),
             (64, [float("nan"), 1.0, 1.0, 1.0]), (65, [float("inf"), 1.0, 1.0, 1.0]), (80, [1.0, 2.0]), (81, [2.0, 1.0]), (None, same)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    want = brute_neighbours([(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in rows], 20)
    got = neighbours(df)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
    assert got[100][:3] == [(101, 6.25), (102, 6.25), (103, 6.25)]
    assert neighbours(df.limit(0)) == {}


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


# --- languages ---------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn(
        "held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    out = langid.identify(docs.filter("held"), langid.learn(docs.filter("not held"))).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_languages_of_awkward_texts(docs):
    df = docs(AWKWARD + ["1 2 3 ...", "der und die"])
    model = {"de": langid.ranked(*langid.gram_counts(["der", "und", "die", "das"])).view(np.int64).tolist()}
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(out) == len(AWKWARD) + 2 and out[len(AWKWARD) + 1].lang_pred == "de"
    for i, t in enumerate([*AWKWARD, "1 2 3 ..."]):
        letters = any(c.isalpha() for c in t or "")
        assert out[i].lang_pred == ("de" if letters else "und") and (letters or out[i].score == 0)
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.learn(df.limit(0)) == {} and langid.learn(df.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_code_of_long_texts(monkeypatch):
    words = [f"wort{'abc'[i % 3]}{'xyz'[i % 7 % 3]}" for i in range(1000)]
    whole = langid.gram_counts(words)
    monkeypatch.setattr(langid, "CHUNK_WORDS", 70)
    assert all(np.array_equal(a, b) for a, b in zip(whole, langid.gram_counts(words)))
    counts = {}
    for w in words:
        p = f"_{w}_"
        for n in range(1, 6):
            for i in range(len(p) - n + 1):
                counts[p[i:i + n]] = counts.get(p[i:i + n], 0) + (p[i:i + n] != "_")
    assert sorted(c for c in counts.values() if c) == sorted(whole[1].tolist())


def test_other_languages_and_noise_are_rejected(spark, docs):
    rng = random.Random(4)
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência"]
    other += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n)) for n in (10, 40, 400, 4000)]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    first = 10**9
    for label in (F.lit(None).cast("string"), F.lit("en")):
        planted = docs(other, first).select("doc_id", label.alias("lang"), "text")
        kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, real.unionAll(planted), SF).select("doc_id").collect()}
        assert kept == {r.doc_id for r in real.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")}


# --- similar documents -------------------------------------------------------------------------
def brute_components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = SEPARATE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w)} if 0 < len(w) < words else {tuple(w[k:k + words]) for k in range(len(w) - words + 1)}))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(i), root(j)))
                parent[b_] = a_
    return sorted((i, len(s), root(i)) for i, s in sets)


def similar(df, **more):
    return sorted(tuple(r) for r in jaccard.similar_documents(df, **more).collect())


def test_similar_documents_in_small_batches(spark, monkeypatch):
    """Texts reach Python in batches of bounded size, however long they are; the session's own limit is back afterwards."""
    def bounded(words, real=jaccard.measure, most=SLICE_BYTES + 100_000):
        def run(batches):
            def checked():
                for batch in batches:
                    if batch.nbytes > most:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch
            return real(words)(checked())
        return run

    monkeypatch.setattr(jaccard, "measure", bounded)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "concat(id div 2, ' ', repeat('x', 6000)) as text")
    found = jaccard.similar_documents(df).collect()
    assert sorted(r.component_id for r in found) == sorted(i - i % 2 for i in range(2000))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize(("words_", "percent"), [(4, 85), (5, 80)])
def test_similar_documents_against_all_pairs(docs, words, words_, percent):
    rng = random.Random(4)
    texts = list(AWKWARD)
    for g in range(12):
        base = words(rng.choice([3, 6, 9, 30, 80, 200]), g).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy).upper() if edits == 1 else " \t".join(copy))
    assert similar(docs(texts).repartition(5), words=words_, percent=percent) == brute_components(list(enumerate(texts)), words_, percent)


def test_large_bucket_of_near_copies(docs, words, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng, base = random.Random(9), words(120, 3).split()
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    assert similar(docs(texts), words=4, percent=85) == brute_components(list(enumerate(texts)), 4, 85)


def test_similar_rows_without_or_with_shared_ids(docs):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = docs([a, b, a]).unionAll(docs([b], 0)).unionAll(docs([a]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str) == sorted(
        [(0, 2, 0), (0, 2, 0), (1, 2, 0), (2, 2, 0), (None, 2, None)], key=str)
    assert similar(docs([])) == []


def test_signatures_miss_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (2, 5, 7, 13, 40, 90, 300):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.06], rng.integers(0, 2**63, rng.integers(0, n // 12 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            # equal sets need none, they have one print
            if len(y) and not np.array_equal(x, y) and 100 * both >= 85 * (len(x) + len(y) - both):
                row, signature = jaccard.signatures([x, y], 85)
                assert set(signature[row == 0].tolist()) & set(signature[row == 1].tolist())
                assert jaccard.apart(jaccard.sketch_of(x), jaccard.sketch_of(y)) <= len(x) + len(y) - 2 * both


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 3), (None, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.integers(1, 70), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([80, 85]))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_signature(n, changes, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = a
    for _ in range(changes):
        if rng.random() < 0.5 and len(b) > 1:
            b = np.delete(b, rng.integers(len(b)))
        else:
            b = np.unique(np.append(b, rng.integers(0, 2**63, dtype=np.uint64)))
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
        row, signature = jaccard.signatures([a, b], percent)
        assert set(signature[row == 0]) & set(signature[row == 1])


@pytest.mark.parametrize("size, percent", [(1, 85), (3, 80), (4, 80), (9, 85), (60, 80), (60, 85)])
def test_small_sets_that_differ_share_hardly_any_signature(size, percent):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(20_000)]
    _, signature = jaccard.signatures(sets, percent)
    counts = np.unique(signature, return_counts=True)[1].astype(np.int64)
    # pairs that meet, for each set: before, thousands
    assert (counts * (counts - 1) // 2).sum() < 2 * len(sets)


# --- chats -------------------------------------------------------------------------------------
HARD = ["<|im_end|>", "<|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nx", "<\\|", "<\\\\n|", "<|", "a<|b", "<n|", "\n", "", None, "plain"]


def chats(df):
    out = chat.render(df).select("*", chat.loss_texts().alias("loss")).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss, r.formatted, r.loss_spans) for r in out}


def test_chats_come_back(spark):
    rows = [(c, t, ["user", "assistant", None, "a\nb<n|<|"][(c + t) % 4], HARD[(c * 5 + t) % len(HARD)], "x")
            for c in range(30) for t in range(c % 7 + 1)]
    rows += [(None, 0, "user", "lost", "x"), (50, None, "assistant", "b", "x"), (50, None, "assistant", "a", "x"), (50, None, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got, want = chats(df), {}
    for c, _, r, t, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert {c: x[0] for c, x in got.items()} == want
    for turns, loss, formatted, spans in got.values():
        assert loss == [t for r, t in turns if r == "assistant"]
        assert not any(chat.START in formatted[s.start:s.end] or chat.END in formatted[s.start:s.end] for s in spans)
        assert all(formatted[s.end:].startswith(chat.END) for s in spans)
        assert formatted.count(chat.START) == formatted.count(chat.END) == len(turns)
    assert chats(df.limit(0)) == {}


def test_plain_turns_stay_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    assert chats(df)[1][2] == "<|im_start|>user\na < b | c<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"


# --- personal data -----------------------------------------------------------------------------
def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ9.0123@+- ()%_١é\n", max_size=60))
def test_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_spans_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + "(" * 200_000, "a.b@c" * 50_000):
        pii.base_spans(text)


def brute_terms(rows):
    """Disclosing terms by document, counted with plain dicts."""
    docs, words, df, both, met, near = [], {}, {}, {}, {}, set()
    for t in rows:
        spans, text = plain_spans(t or ""), t or ""
        found = [(m.start(), m.end(), m[0].lower()) for m in pii.WORD.finditer(text) if len(m[0]) >= 3]
        for w in {w for _, _, w in found}:
            words[w] = words.get(w, 0) + 1
        free = [w for w in found if all(w[1] <= a or w[0] >= b for _, a, b in spans)]
        named = {(k, a, b): k + ":" + (text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for k, a, b in spans}
        values, terms = set(named.values()), {w for _, _, w in free}
        docs.append((values, terms))
        for v in values:
            df[v] = df.get(v, 0) + 1
            for w in terms:
                both[v, w] = both.get((v, w), 0) + 1
                met.setdefault((v, w), set()).add(t)
        for (_, a, b), v in named.items():
            near |= {(v, w) for _, _, w in [x for x in free if x[1] <= a][-6:] + [x for x in free if x[0] >= b][:6]}
    n, out = len(rows), []
    for values, terms in docs:
        out.append({w for v in values for w in terms if df[v] < n and (len(met[v, w]) > 1 or (v, w) in near)
                    and np.log(both[v, w] * n / (df[v] * words[w])) / np.log(n / df[v]) >= pii.GENERALISE - 1e-12})
    return out


def test_disclosing_terms(docs, words):
    texts = [words(30, s, 20) for s in range(40)]
    texts[3] += " Miriam Quastel writes from m.q@mail.example.org or +1 (555) 123-4567 now"
    texts[5] += " Quastel 10.20.30.40 again"
    texts[6] += " m.q@mail.example.org w1x w2x"
    out = {r.doc_id: r for r in pii.sanitise(docs(texts + AWKWARD)).collect()}
    told = brute_terms(texts + AWKWARD)
    for i, t in enumerate(texts + AWKWARD):
        spans = [(s.kind, s.start, s.end) for s in out[i].spans]
        assert [s for s in spans if s[0] != "term"] == plain_spans(t or "")
        assert {(t or "")[a:b].lower() for k, a, b in spans if k == "term"} == {w for w in told[i] if w in (t or "").lower()}
    assert "Miriam" not in out[3].clean_text and "m.q@" not in out[3].clean_text and "[EMAIL]" in out[3].clean_text
    assert out[0].clean_text == texts[0] and out[0].spans == []
    assert out[len(texts)].clean_text is None
    assert pii.sanitise(docs([])).count() == 0


def test_terms_disclose_at_any_distance(docs, words):
    """Names that meet a value in two texts go at any distance; in one text only those near it do."""
    fill = [f"alpha bravo {words(30, s, 20)} charlie" for s in range(60)]
    far = " alpha bravo charlie" * 20
    texts = fill + [f"Miriam Quastel{far} m.q@mail.example.org", f"m.q@mail.example.org{far} by Miriam Quastel",
                    f"Orsolya Tamm 10.20.30.40{far}", f"10.20.30.40{far} Orsolya Tamm", f"Alma Vesk 10.20.30.41{far} unrelated"]
    for more in ([], texts[-1:] * 2):
        out = [r.clean_text for r in pii.sanitise(docs(texts + more)).collect()]
        assert sum("alpha" in t for t in out) == len(texts + more)
        assert not any(name in t for t in out for name in ("Miriam", "Quastel", "Orsolya", "Tamm", "Alma", "Vesk"))
        assert sum("unrelated" in t for t in out) == 1 + len(more)


def test_little_text_is_lost_and_many_values_are_linear(spark, docs):
    """Words taken out for each value, and the share of text that stays; a document of 10^4 values and 10^4 rare words."""
    found = pii.sanitise(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    values = sum(s.kind != "term" for r in found for s in r.spans)
    terms = sum(s.kind == "term" for r in found for s in r.spans)
    assert 0 < values and terms <= 12 * values
    lost = sum(s.end - s.start for r in found for s in r.spans if s.kind == "term")
    assert lost < 0.005 * sum(len(r.text or "") for r in found)
    log = " ".join(f"10.{i // 250}.{i % 250}.7 rare{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760)}x"
                   for i in range(10_000))
    out = pii.sanitise(docs([log, "other text", "and more of it"])).orderBy("doc_id").collect()
    assert sum(s.kind == "ip" for s in out[0].spans) == 10_000


# --- benchmark leaks ---------------------------------------------------------------------------
def brute_score(item, text):
    x, y = decontam.words_of(item), decontam.words_of(text or "")
    h, best = np.zeros((len(x) + 1, len(y) + 1), dtype=int), 0
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best / len(x)


def test_leaks_against_full_alignment(spark, docs, words):
    rng = random.Random(8)
    items = [words(rng.randrange(12, 50), 1000 + i, 3000) for i in range(8)] + ["two words", "", None]
    texts = list(AWKWARD)
    for i in range(8):
        w = items[i].split()
        for edit in (0, 0.1, 0.2, 0.6, 1):
            copy = [x if rng.random() >= edit else f"z{rng.randrange(10**6)}" for x in w]
            if edit == 0.1:
                copy.insert(len(copy) // 2, "inserted")
                del copy[2]
            texts.append(f"{words(80, i)} {' '.join(copy).upper()}, {words(80, 99 + i)}")
        texts.append(f"{words(20, i)} {' '.join(w[:len(w) // 3])}")
    texts += [texts[14]] * 30  # an item that many documents hold keeps seeds
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs(texts), bench).collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items[:8]) if (s := brute_score(item, t)) >= 0.5}
    assert {k: round(r.score, 9) for k, r in got.items()} == {k: round(s, 9) for k, s in want.items()}
    for (d, i), r in got.items():
        if r.score == 1:
            assert decontam.words_of(texts[d])[r.first_word:r.end_word] == decontam.words_of(items[i])
    assert decontam.contaminated(docs([]), bench).count() == 0
    assert decontam.contaminated(docs(texts), bench.limit(0)).count() == 0


def test_leaks_that_many_documents_hold_edited(spark, docs, words, monkeypatch):
    item, other = words(40, 1, 3000), words(40, 2, 3000)
    fifth = " ".join("z" + w if i % 5 == 4 else w for i, w in enumerate(item.split()))
    half = " ".join(other.split()[:20])
    fill = [words(50, 100 + i).replace("w", "f") for i in range(90)]
    texts = [item] + [f"{f} {fifth} {f}" for f in fill[:40]] + [f"{f} {half}" for f in fill[40:80]] + fill[81:] + [other]
    bench = spark.createDataFrame([(0, item), (1, other), (2, item)], "item_id long, text string")
    # seven changes inside the aligned words, the eighth stands behind them
    want = {(d, i, 25 / 40 if d else 1.0) for d in range(41) for i in (0, 2)} | {(d, 1, 0.5) for d in range(41, 81)} | {(90, 1, 1.0)}
    for size in (decontam.BLOCK_WORDS, 40):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", size)
        got = decontam.contaminated(docs(texts), bench).collect()
        assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in got} == want and len(got) == len(want)


def test_leaks_with_inserted_words(spark, docs, words):
    """A foreign word after every two scores 21 of 40; short items over few words meet everywhere."""
    rng, item = random.Random(5), words(40, 1, 3000)
    spread = " ".join(w + (" foreign" if i % 2 else "") for i, w in enumerate(item.split()))
    thrice = " ".join(w + (" foreign" if i % 3 == 2 else "") for i, w in enumerate(item.split()))
    items = [item] + [words(rng.randrange(3, 14), 50 + i, 12) for i in range(25)] + ["w1x w1x w1x w1x", "w1x w2x w1x w2x w1x"]
    texts = [spread, f"{words(30, 7)} {spread} {words(30, 8)}", thrice, item, "w1x " * 40, "w1x w2x " * 20]
    texts += [words(rng.randrange(1, 60), 200 + i, 12) for i in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontam.contaminated(docs(texts), bench).collect()}
    want = {(d, i): round(s, 9) for d, t in enumerate(texts) for i, x in enumerate(items) if (s := brute_score(x, t)) >= 0.5}
    assert got == want and {(d, 0) for d in range(4)} <= set(got)


# --- pipeline ----------------------------------------------------------------------------------
def test_pipeline_against_plain_loops(spark, library_tokens):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    model = langid.Identifier(langid.learn(docs))
    kept = [(r.doc_id, r.text) for r in rows for found in [model.score(r.text)] if found[0] != "und" and found[1] >= corpus_pipeline.MIN_SCORE]
    heads = {i for i, _, c in brute_components(kept, 5, 80) if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if i in heads]
    # full alignment only where two words in a row are shared
    grams = [(x, {tuple(w[k:k + 2]) for w in [decontam.words_of(x)] for k in range(len(w) - 1)}) for x in items]
    clean = []
    for i, t in kept:
        w = decontam.words_of(t)
        own = {tuple(w[k:k + 2]) for k in range(len(w) - 1)}
        if not any(len(g & own) > 0.25 * len(g) and brute_score(x, t) >= 0.5 for x, g in grams):
            clean.append((i, t))
    told = brute_terms([t for _, t in clean])
    want = {}
    for (i, t), terms in zip(clean, told):
        spans = [(k, a, b, "replace") for k, a, b in plain_spans(t)]
        taken = {x for _, a, b, _ in spans for x in range(a, b)}
        assert not terms or spans
        want[i] = (t, bool(spans), terms, taken)
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start)), "<u4")
        text = library_tokens.decode(ids[:-1].tolist(), skip_special_tokens=False)
        t, private, terms, _ = want[i]
        if not private:
            assert text == t
        else:
            assert plain_spans(text) == [] and not terms & {w.lower() for w in pii.WORD.findall(text)} - {"term", "email", "card", "phone"}
        assert ids[-1] == 0


@pytest.fixture(scope="module")
def library_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


CLASH = {"least": 1, "score": 2.5, "spans": "x", "__row": 3, "key": "k", "c0": 4, "component": "c", "lang_pred": "q", "n": 5, "goes": "g",
         "clean_text": "t", "id": 6, "of": "o"}


def clashing(spark, rows):
    """Documents from (id, text) with columns of all names that stages use inside."""
    kinds = ", ".join(f"{n} {({int: 'int', float: 'double', str: 'string'})[type(v)]}" for n, v in CLASH.items())
    return spark.createDataFrame([(i, t, "en", "s", 0, *CLASH.values()) for i, t in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars int, {kinds}")


def test_stages_keep_columns_values_and_types(spark, words):
    odd = [*enumerate(AWKWARD), *enumerate(AWKWARD[4:8]), (None, "lost text of some words here"), (None, None)]
    for df in (clashing(spark, odd), clashing(spark, [])):
        texts = {r.text for r in df.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema]
            for r in out.collect():
                assert {c: r[c] for c in CLASH} == CLASH and r.source == "s"
                assert name == "personal_data" or r.text in texts
                assert name == "language" or r.lang == "en"
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()


def test_near_duplicates_under_one_id_and_without_ids(spark, words):
    """A third of the rows under one id, some without: no clean row goes, no copy stays, and the choice is fixed."""
    clean = [words(30, i, 5000) for i in range(60)]
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, t) for i, t in enumerate(clean)]
    copies = [(7, clean[0]), (7, clean[0]), (None, clean[1]), (None, clean[3]), (2, clean[4]), (500, clean[5]), (None, clean[6] + " end")]
    kept = [sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, clashing(spark, x), SF).collect()), key=str)
            for x in (rows + copies, copies[::-1] + rows[::-1])]
    # the row without an id gives way to its copy that has one
    assert kept[0] == kept[1] == sorted([(2 if t == clean[4] else i, t) for i, t in rows], key=str)


def test_scores_against_a_plain_loop(spark, docs):
    """Out-of-place distance, ties and score, counted n-gram by n-gram."""
    def plain_ranks(text):
        counts = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f"_{''.join(c for c in w if c.isalpha())}_"
            if w != "__":
                counts.update(g for n in range(1, 6) for g in (w[k:k + n] for k in range(len(w) - n + 1)) if g != "_")
        code = {g: langid.code_of(g) for g in counts}
        return sorted(counts, key=lambda g: (-counts[g], code[g]))[:langid.PROFILE]

    samples = {"a": "the cat and the hat " * 5, "b": "der hund und die katze " * 5, "c": "the cat and the hat " * 5}
    df = docs(list(samples.values())).withColumn("lang", F.element_at(F.array(*map(F.lit, samples)), F.col("doc_id").cast("int") + 1))
    model = langid.learn(df)
    ranks = {lang: plain_ranks(t) for lang, t in samples.items()}
    texts = [*AWKWARD, "½ ² ③", "½x", "the hund", "der hat", "x²y the", *samples.values()]
    for r in langid.identify(docs(texts), model).collect():
        own = plain_ranks(r.text or "")
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        apart = {lang: sum(abs(i - p.index(g)) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in ranks.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        assert (r.lang_pred, round(r.score, 12)) == (best, round(1 - apart[best] / (langid.PROFILE * len(own)), 12))
