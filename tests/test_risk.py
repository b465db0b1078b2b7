from collections import Counter
from math import log, log2

import pytest
from pyspark.sql import functions as F

from siftwarden.functions import scalars
from siftwarden.operators import filters, risk
from siftwarden.operators.detect import active_rules, detect, match_counts
from siftwarden.plans import profiles
from siftwarden.plans.rule_index import build_index
from siftwarden.rules import load_catalogue
from siftwarden.schema import CATEGORY_WEIGHTS, CONFIDENCE_FACTORS, SEVERITY_WEIGHTS


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(F.expr(expression)).first()[0]


def entropy(t, base=None):
    size = len(t.encode())
    return -sum(n / size * (log2(n / size) if base is None else log(n / size) / log(base)) for n in Counter(t).values())


TEXTS = ["", "aaaa", "abcd", "aAbB12==", "é", "éà日本", "The quick brown fox\n", "".join(map(chr, range(200, 400))), "😀😀x"]


@pytest.mark.parametrize("t", TEXTS)
def test_entropy_divides_by_bytes(spark, t):
    assert one(spark, scalars.shannon_entropy("t"), t=t) == pytest.approx(entropy(t), abs=1e-9)
    assert one(spark, scalars.entropy_base("t", "2D"), t=t) == pytest.approx(entropy(t, 2) / log(2), abs=1e-9)
    density = len(set(t)) / len(t.encode()) if t else 0
    assert one(spark, scalars.information_density("t"), t=t) == pytest.approx(density)
    assert one(spark, scalars.guessability("t"), t=t) == pytest.approx(entropy(t) / 8 * 70 + density * 30, abs=1e-9)


def test_scalar_tables(spark):
    classes = [one(spark, scalars.classify_entropy("e"), e=e) for e in (1.0, 2.5, 3.5, 4.5, 6.0)]
    assert classes == ["very_low", "low", "medium", "high", "very_high"]
    levels = [one(spark, scalars.risk_level("s"), s=s) for s in (0, 10, 30, 75, 150)]
    assert levels == ["none", "low", "medium", "high", "critical"]
    assert one(spark, scalars.risk_description("'high'", "2", "75")) == "High risk - 2 findings, score: 75"
    assert one(spark, scalars.risk_description("'critical'", "2", "175")) == "CRITICAL risk - 2 findings, score: 175"
    base64 = {"SGVsbG8=": True, "abcd": True, "1234": False, "ab=": False, "ab!d": False, "abcde": False, "12==": True}
    assert {t: one(spark, scalars.is_base64("t"), t=t) for t in base64} == base64
    hexes = {"deadBEEF": True, "abc": False, "ab": False, "xyzw": False, "12\n4": False}
    assert {t: one(spark, scalars.is_hex("t"), t=t) for t in hexes} == hexes
    paths = {"a/b.GO": "go", "x.hxx": "cpp", "x.mjs": "javascript", "x.txt": None, "README": None}
    assert {p: one(spark, scalars.language("p"), p=p) for p in paths} == paths
    assert one(spark, scalars.truncated("t"), t="é" * 40) == "é" * 40
    assert one(spark, scalars.truncated("t"), t="a" * 61) == "a" * 60 + "..."


def test_sql_functions(spark):
    names = scalars.register_functions(spark)
    assert "sw_shannon_entropy" in names
    row = spark.sql("select sw_shannon_entropy('abcd') e, sw_risk_level(30) l, sw_sarif_level('low') s, "
                    "sw_is_hex('beef') h, sw_language('a.rs') g, sw_fingerprint('r', 'f', 1, 'm') k").first()
    assert tuple(row) == (2.0, "medium", "note", True, "rust", "r:f:1:m")


def rows(spark, *data):
    return spark.createDataFrame(data, "id string, category string, severity string, confidence string, n bigint")


def test_two_high_secrets(spark):
    r = risk.risk_score(rows(spark, ("a", "secrets", "high", "high", 2))).first()
    assert (r.score, r.level, r.finding_count, r.highest_severity) == (75, "high", 2, "high")
    assert r.by_category["secrets"].score == 75.0 and r.by_category["secrets"].n == 2


def test_truncation_is_per_category(spark):
    data = [("a", "pii", "low", "low", 1), ("a", "finance", "low", "low", 1), ("a", "x", "odd", "odd", 1)]
    # 1.56, 1.2 and 0.5 points
    assert risk.risk_score(rows(spark, *data)).first().score == 2


def test_scores_against_brute_force(spark):
    import itertools
    data = [(f"d{i % 7}", c, s, k, i % 5 + 1) for i, (c, s, k) in enumerate(itertools.product(
        [*CATEGORY_WEIGHTS, "other"], [*SEVERITY_WEIGHTS, "odd"], [*CONFIDENCE_FACTORS, "odd"]))]
    want = {}
    for i, c, s, k, n in data:
        want[(i, c)] = want.get((i, c), 0) + n * SEVERITY_WEIGHTS.get(s, 1) * round(10 * CONFIDENCE_FACTORS.get(k, .5)) * round(
            10 * CATEGORY_WEIGHTS.get(c, 1))
    total = Counter()
    for (i, _), units in want.items():
        total[i] += units // 100
    sources = spark.createDataFrame([("d0",), ("empty",)], "id string")
    got = {r.id: (r.score, r.level) for r in risk.risk_by_source(rows(spark, *data), sources).collect()}
    assert got.pop("empty") == (0, "none")
    assert {k: v[0] for k, v in got.items()} == dict(total)


def test_custom_weights_replace_the_defaults(spark):
    data = rows(spark, ("a", "pii", "high", "high", 2), ("a", "secrets", "low", "high", 1))
    r = risk.risk_score(data, {"high": 7}, {"secrets": 2.5}).first()
    assert r.score == 14 + 2  # unknown weights count as 1
    assert risk.risk_score(data, {}, {}).first().score == risk.risk_score(data).first().score == 65 + 4


def test_actions(spark):
    table = {(r.level, r.kind): (r.action, r.priority) for r in risk.action_table(spark).collect()}
    assert len(table) == 35
    assert table[("low", "secrets")] == ("review", 4) and table[("critical", "code-quality")] == ("block", 1)
    assert table[("medium", "compliance")] == ("compliance_review", 3) and table[("none", "security")] == ("none", 5)
    assert set(risk.KIND_OF_CATEGORY) == {r["category"] for r in load_catalogue()}


def test_partial_statistics_add_up(spark, content):
    rules = load_catalogue(["pii"])
    index = build_index(rules)
    texts = ["a@b.org 123-45-6789", "x\0y", "nothing", "c@d.org " * 3]
    stats = lambda c: risk.scan_stats(c, match_counts(c, index), index)
    whole = {tuple(r) for r in stats(content(*texts)).collect()}
    merged = {tuple(r) for r in risk.stats_merge(stats(content(*texts[:1])), stats(content(*texts[1:]))).collect()}
    assert whole == merged and ("rows_skipped", "", 1) in whole and ("findings", "", 6) in whole


def test_throughput_without_duration(spark):
    runs = spark.createDataFrame([("a", 0, 5, 10, 1), ("a", 500, 5, 2**20, 2)],
                                 "name string, duration_ms bigint, files bigint, bytes bigint, findings bigint")
    r = risk.throughput(runs).first()
    assert (r.runs, r.files_per_second, r.mb_per_second, r.findings) == (2, 5.0, 1.0, 3)


def test_ranks_of_a_long_source(spark, rule):
    rules = [rule("a", "x", 0, severity="low"), rule("b", "y", 1, severity="critical")]
    df = spark.createDataFrame([("d", "x" * 40 + "y" * 5 + "x" * 40)], "id string, text string")
    ranked = risk.rank_findings(detect(df, rules), span=16).orderBy("position").collect()
    assert [r.position for r in ranked] == list(range(1, 86))
    assert [r.rule for r in ranked[:5]] == ["b"] * 5 and [r.start_byte for r in ranked[5:]] == [*range(40), *range(45, 85)]


def test_gate_and_density(spark, content):
    found = rows(spark, ("d0", "pii", "medium", "high", 1), ("d1", "pii", "high", "high", 30))
    source = content("a\nb", "c", "d")
    assert {r.id: r.passes for r in filters.gate_passes(found, "high", source).collect()} == {"d0": True, "d1": False, "d2": True}
    density = {r.id: (r.density, r.band) for r in risk.finding_density(found, source).collect()}
    assert density == {"d0": (500.0, "high"), "d1": (30000.0, "high"), "d2": (0.0, "low")}


def test_filters(spark, content):
    assert filters.filter_size(content("é" * 3, "abc"), 5).count() == 1
    assert filters.filter_size(content("x"), 0).count() == 0
    assert filters.filter_binary(content("a\0", "b", "x" * 8192 + "\0")).count() == 2
    files = spark.createDataFrame([(p,) for p in (
        "debug.log", "a/b.log", "src/main.rs", "node_modules/x.js", "a/target/x", ".git/config", "a/targets/x", "src/a1.rs")], "path string")
    globs = filters.ignore_globs("# c\n\n*.log\n!a/b.log\nsrc/a[0-9].rs\n")
    assert globs == ["*.log", "src/a[0-9].rs"]
    assert {r.path for r in filters.filter_ignored(files, globs).collect()} == {"src/main.rs", "a/targets/x"}
    assert filters.glob_to_regex("a?b*") == "(?s)^a.b.*\\z"


def test_profiles():
    rules = active_rules(load_catalogue())
    assert {r["category"] for r in profiles.preset("production").rules(rules)} == {"secrets", "pii", "code-quality"}
    assert {r["category"] for r in profiles.preset("pipeline").rules(rules)} == {"secrets", "pii", "code-quality", "devops"}
    assert len(profiles.preset("development").rules(rules)) == len(rules)
    with pytest.raises(ValueError):
        profiles.preset("none")
