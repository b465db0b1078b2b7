import re

from hypothesis import HealthCheck, given, settings, strategies as st

from siftwarden.operators import suppress
from siftwarden.operators.detect import capture_groups, category_hits, detect, match_counts, match_spans
from siftwarden.rules import load_catalogue


def expected(texts, rules):
    out = set()
    for i, text in enumerate(texts):
        for r in rules:
            for m in re.finditer(r["match"], text, re.ASCII):
                start = len(text[:m.start()].encode())
                out.add((f"d{i}", r["name"], text.count("\n", 0, m.start()) + 1, start,
                         start + len(m.group().encode()), m.group()))
    return out


def got(findings):
    return {(r.id, r.rule, r.line, r.start_byte, r.end_byte, r.matched) for r in findings.collect()}


def test_matches_agree_with_brute_force(spark, content):
    rules = load_catalogue(["pii", "web_security", "accessibility"])
    texts = ["ssn 123-45-6789\nmail a.b@c.org and 4111 1111 1111 1111\n<img src=x>\n<html>", "", "é\n\né 123-45-6789 é",
             "x" * 50 + "\n" + "<button>" * 700 + " 10.0.0.1 localhost", "password = 'hunter2'\r\nselect 1"]
    assert got(detect(content(*texts), rules)) == expected(texts, rules)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(st.lists(st.lists(st.sampled_from(["ab", "é", "\n", "123", " ", "ssn", "x-1", "\r\n", "😀", "12"]), max_size=30), max_size=12))
def test_offsets_slice_back_to_the_match(spark, content, pieces):
    texts = ["".join(p) for p in pieces] or [""]
    rules = [{"name": "n", "match": r"\d+|ab", "ordinal": 0}, {"name": "w", "match": r"ssn\s", "ordinal": 1}]
    full = [{**load_catalogue(["arm"])[0], **r} for r in rules]
    rows = got(detect(content(*texts), full))
    assert rows == expected(texts, full)
    for i, _, _, start, end, matched in rows:
        assert texts[int(i[1:])].encode()[start:end].decode() == matched


def test_counts_equal_spans(spark, content):
    rules = load_catalogue()
    rows = content("api_key = 'abcdefghij0123456789'\nFROM python:3.9\nkind: Secret", "with print(1) 30223 TODO: x")
    counts = {(r.id, r.ordinal): r.matches for r in match_counts(rows, rules).collect()}
    spans = {}
    for r in match_spans(rows, rules).collect():
        spans[(r.id, r.ordinal)] = spans.get((r.id, r.ordinal), 0) + 1
    env = {r["ordinal"] for r in rules if r["env_var"]}
    assert counts == spans and counts and not env & {o for _, o in counts}


def test_entropy_floor(spark, content, rule):
    rows = content("key=aaaaaaaaaaaa key=a1b2c3d4e5f6")
    assert detect(rows, [rule("k", "key=[a-z0-9]{12}", min_entropy=3.0)]).count() == 1
    assert match_counts(rows, [rule("k", "key=[a-z0-9]{12}", min_entropy=3.0)]).first().matches == 1
    assert detect(rows, [rule("k", "key=[a-z0-9]{12}")]).count() == 2


def test_anchors_and_lines(spark, content, rule):
    rows = content("foo\nfoo\n", "foo")
    assert got(detect(rows, [rule("a", "^foo")])) == {("d0", "a", 1, 0, 3, "foo"), ("d1", "a", 1, 0, 3, "foo")}
    assert got(detect(rows, [rule("z", "foo$")])) == {("d1", "z", 1, 0, 3, "foo")}
    per_line = got(detect(rows, [rule("a", "^foo$")], per_line=True))
    assert per_line == {("d0", "a", 1, 0, 3, "foo"), ("d0", "a", 2, 4, 7, "foo"), ("d1", "a", 1, 0, 3, "foo")}


def test_unicode_option(spark, content, rule):
    rows = content("été")
    word = [rule("w", r"\bt\b")]
    assert detect(rows, word).count() == 1
    assert detect(rows, word, unicode=True).count() == 0


def test_first_attribution(spark, content, rule):
    rules = [rule("wide", r"\d+", 0), rule("narrow", r"\d{3}-\d", 1), rule("other", r"\d{3}-\d", 2, category="x")]
    found = detect(content("555-1"), rules, attribution="first")
    assert sorted(r.rule for r in found.collect()) == ["other", "wide", "wide", "wide"]


def test_groups(spark, content, rule):
    rows = capture_groups(content("k=1 k= k=22"), rule("g", r"k=(\d+)?"), 1).orderBy("match_index").collect()
    assert [(r.matched, r.groups) for r in rows] == [("k=1", ["1"]), ("k=", [None]), ("k=22", ["22"])]


def test_category_gate(spark, content):
    rows = content("mail a@b.org", "nothing")
    assert {(r.id, r.category) for r in category_hits(rows, load_catalogue(["pii", "finance"])).collect()} == {("d0", "pii")}


def test_many_matches_in_one_row(spark, content, rule):
    text = "ab\n" * 3000
    rows = detect(content(text), [rule("m", "ab")]).collect()
    assert len(rows) == 3000 and {(r.line, r.start_byte) for r in rows} == {(i + 1, 3 * i) for i in range(3000)}


def test_hot_id_and_copies(spark, rule):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"d{i}", "tel 555-1 555-2") for i in range(300)], "id string, text string")
    found = detect(rows, [rule("r", r"\d{3}-\d")])
    assert found.count() == 600 and found.where("id = 'hot'").count() == 200


def test_large_input_is_not_shuffled(spark, rule, monkeypatch):
    from siftwarden import session

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) id", "text")
    plan = lambda: match_counts(df, [rule("r", r"x \d")])._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in plan()
    monkeypatch.setattr(session, "SMALL_PER_CORE", 1)
    assert "BroadcastHashJoin" in plan() and "Exchange hash" not in plan() and "RoundRobin" not in plan()


def test_suppression_scopes(spark, content, rule):
    rules = [rule("tel", r"555-\d", 0), rule("num", r"\d{3}", 1)]
    text = ("555-1 // scan:ignore:tel\n# scan:ignore:num\n555-2\n/* scan:ignore */\n555-3\n555-4 # scan:ignore\n"
            "/* scan:ignore:tel\n555-5\n// scan:ignore:num 555-6")
    rows = content(text)
    found = detect(rows, rules)

    def left(scope):
        return sorted((r.line, r.rule) for r in suppress.suppress_inline(found, rows, scope).collect())

    everything = sorted((r.line, r.rule) for r in found.collect())
    assert left("same_line") == everything
    assert left("trailing") == [x for x in everything if x not in [(1, "tel"), (6, "num"), (6, "tel")]]
    assert left("next_line") == [x for x in everything if x not in [(3, "num"), (5, "num"), (5, "tel")]]
    assert {(r.rule, r.directives) for r in suppress.suppression_list(rows).collect()} == {("tel", 1), ("num", 1), ("*", 2)}


def test_baseline_round_trip(spark, content, rule, tmp_path):
    rules = [rule("tel", r"555-\d")]
    old, new = detect(content("555-1"), rules), detect(content("555-1\n555-2"), rules)
    base = suppress.create_baseline(old)
    assert [r.matched for r in suppress.suppress_baseline(new, base).collect()] == ["555-2"]
    for name, body in (("a.json", '["tel:d0:1:555-1"]'), ("b.json", '[{"fingerprint": "tel:d0:1:555-1"}]'),
                       ("c.json", "tel:d0:1:555-1\n"), ("d.json", '{"fingerprint": "tel:d0:1:555-1"}\n')):
        (tmp_path / name).write_text(body)
        read = suppress.read_baseline(spark, str(tmp_path / name))
        assert suppress.suppress_baseline(new, read).count() == 1, name
    status = {r.fingerprint: r.status for r in suppress.baseline_diff(new, base).collect()}
    assert status == {"tel:d0:1:555-1": "unchanged", "tel:d0:2:555-2": "new"}
    assert suppress.dedup(new.unionByName(new)).count() == 2


def test_attribution_by_the_gate_is_that_of_every_peer(spark, content):
    """Over all packs: the rules the gate brings up name each match like a trial of all rules of the category."""
    from siftwarden.operators import detect as module
    from siftwarden.plans.rule_index import build_index
    from siftwarden.rules import load_catalogue
    rules = module.active_rules(load_catalogue())
    index = build_index(rules)
    table = content("mail a.b@c.org, ssn 123-45-6789, card 4111 1111 1111 1111", "password = 'hunter2' api_key: abcdef0123456789abcdef",
                    "<img src=x><script>eval(a)</script> ignore previous instructions", "SELECT * FROM t WHERE id = 1; TODO: fix me 10.0.0.1")
    spans = module.match_spans(table, index)
    columns = ["id", "ordinal", "matched", "start_byte"]
    got = sorted(map(tuple, module.attribute_first(spans, index).select(columns).collect()))
    assert got == sorted(map(tuple, module._attribute_rowwise(spans, index).select(columns).collect())) and len(got) > 10
    distinct = spans.select("matched").distinct().count()
    assert module.attribution_tries(spans, index).count() < 0.1 * distinct * len(rules)


def test_groups_of_every_rule_unset_or_empty(content, rule):
    import re
    patterns = [r"k=(\d+)?", r"(a|b(c)?)(x*)", r"((\d)(\d)?)-(y?)", r"(?:q(r)?)+", r"z[(]([^)]*)[)]", r"w(?i:(E)|(f))", r"plain"]
    texts = ["k=1 k= k=22", "ax bcx b a bcxx", "1- 12-y 3-", "qrq q qr", "z() z(in)", "wE we wf wF", "plain", ""]
    rules = [rule(f"r{i}", p, i) for i, p in enumerate(patterns)]
    got = sorted((r.id, r.rule, r.start_byte, tuple(r.groups)) for r in detect(content(*texts), rules, groups=True).collect())
    want = sorted((f"d{i}", f"r{k}", m.start(), m.groups()) for i, t in enumerate(texts) for k, p in enumerate(patterns) for m in re.finditer(p, t))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]
    assert {g[3] for g in got if g[1] == "r0"} == {("1",), (None,), ("22",)}
    plain = detect(content(*texts), rules).drop("ordinal")
    assert sorted(map(str, plain.collect())) == sorted(map(str, detect(content(*texts), rules, groups=True).select(plain.columns).collect()))


def test_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    """A large file of one row group is dealt over tasks of bounded size, not left to one."""
    from siftwarden import session

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) id", "text")
    monkeypatch.setattr(session, "SMALL_PER_CORE", 1)
    monkeypatch.setattr(session, "BYTES_A_TASK", 4096)
    size = session.read_bytes(df)
    assert size > 100_000 and session.spread(df).rdd.getNumPartitions() == size // 4096
    assert session.spread(df.crossJoin(spark.range(1000))).rdd.getNumPartitions() == size // 4096


def test_gate_folds_without_a_pass_by_letter(spark, content, rule):
    """The text is folded by native ``lower`` and ``replace``; spellings of i, k and s, and upper-case letters, lose nothing."""
    from siftwarden.operators.detect import candidates
    from siftwarden.plans.rule_index import build_index

    patterns = ["(?iu)kiss", "\u00dcberweisung", "\u00fcberweisung", "Stra\u00dfe", "(?i)token", "id=\\d+", "\u03a3\u03a3", "\u20ac9"]
    rules = [rule(f"r{i}", p, i) for i, p in enumerate(patterns)]
    texts = ["KISS k\u0130\u017fs \u212a\u0131\u017f\u017f kiss", "\u00dcberweisung \u00fcberweisung \u00dcBERWEISUNG", "Stra\u00dfe STRA\u00dfE", "ToKeN \u00c9 TOKEN",
             "id=12 ID=3 \u20ac9", "\u03a3\u03a3", "x\u03a3\u03a3 y", ""]
    index = build_index(rules)
    got = {(r.id, r.rule): r.n for r in detect(content(*texts), rules).groupBy("id", "rule").count().withColumnRenamed("count", "n").collect()}
    assert got == {("d0", "r0"): 4, ("d1", "r1"): 1, ("d1", "r2"): 1, ("d2", "r3"): 1, ("d3", "r4"): 2, ("d4", "r5"): 1, ("d4", "r7"): 1,
                   ("d5", "r6"): 1, ("d6", "r6"): 1}
    assert "translate(text" not in candidates(content(*texts), index)._jdf.queryExecution().toString()


def test_gate_leads_to_every_literal():
    import re
    from siftwarden.plans import patterns
    from siftwarden.rules import load_catalogue

    literals = sorted({lit for r in load_catalogue() for lit in patterns.required_literals(r["match"])})
    gate = re.compile(patterns.gate_pattern(literals))
    for literal in literals:
        found = gate.match(literal)
        assert found and found[1] == literal
    # most positions of a text without a literal end at the first characters
    lead = re.compile(patterns._lead(["token", "key", "=", "ac"]))
    assert [lead.match(x) is not None for x in ("token", "kok", "toast", "ac", "=", "zoo", "kk", "")] == [True, True, False, True, True, False, False, False]
