import re
from collections import Counter
from re import _constants as K
from re import _parser as regex_parser

import pytest

from siftwarden.operators import catalog
from siftwarden.operators.detect import match_counts
from siftwarden.plans import patterns
from siftwarden.plans.rule_index import build_index
from siftwarden.rules import PACK_ORDER, load_catalogue, load_pack

# pack -> critical, high, medium, low
GRADES = {
    "pii": (7, 17, 5, 10), "compliance": (0, 4, 12, 17), "security_hardening": (14, 13, 4, 2), "ai_safety": (0, 5, 11, 9),
    "llm_guardrails": (4, 9, 8, 4), "healthcare": (0, 0, 7, 0), "finance": (0, 0, 6, 0), "web_security": (7, 11, 14, 5),
    "ai_detection": (0, 0, 0, 25), "accessibility": (0, 1, 14, 7), "web_development": (0, 1, 2, 9), "pwa": (0, 0, 5, 0),
    "infrastructure": (0, 2, 9, 44), "cloud_native": (1, 2, 9, 26), "supply_chain": (0, 1, 14, 20), "frameworks": (1, 19, 6, 5),
    "git_hygiene": (0, 1, 2, 25), "performance": (0, 2, 12, 8), "shift_left": (0, 0, 1, 19), "code_quality": (0, 1, 4, 10),
    "devops": (1, 6, 5, 3), "kubernetes": (1, 5, 5, 0), "api_integration": (0, 0, 9, 0), "terraform": (2, 4, 1, 0),
    "data_visualization": (0, 0, 5, 0), "container": (2, 2, 0, 0), "graphql": (0, 2, 2, 0), "metadata": (0, 0, 1, 3),
    "cloudformation": (1, 1, 1, 0), "git_ops": (2, 1, 0, 0), "arm": (0, 2, 0, 0),
}


def test_catalogue_size_and_names():
    rules = load_catalogue()
    assert len(PACK_ORDER) == 32 and len(rules) == 620
    assert [r["ordinal"] for r in rules] == list(range(620))
    assert max(Counter(r["name"] for r in rules).values()) == 1
    assert sum(r["env_var"] for r in rules) == 3


@pytest.mark.parametrize("pack", sorted(GRADES))
def test_grades_of_pack(pack):
    count = Counter(r["severity"] for r in load_pack(pack))
    assert tuple(count[s] for s in ("critical", "high", "medium", "low")) == GRADES[pack]


def test_every_pattern_is_usable():
    usable, refused = catalog.split_compilable(load_catalogue())
    assert not refused and len(usable) == 620


@pytest.mark.parametrize("bad", ["", "(", "a*", "x|"])
def test_bad_patterns_are_refused(bad, rule):
    usable, refused = catalog.split_compilable([rule("r", bad)])
    assert not usable and refused[0]["problem"]
    with pytest.raises(ValueError):
        build_index([rule("r", bad)])


def test_unreachable_entropy_floors():
    dead = {name for name, _, _ in catalog.dead_rules(load_catalogue())}
    assert "security-hardening-aws-access-key" in dead


def _text(items, gap):
    """The shortest text of a parsed pattern; ``gap`` is written for optional repetitions of anything."""
    out = []
    for op, value in items:
        if op is K.LITERAL:
            out.append(chr(value))
        elif op is K.NOT_LITERAL:
            out.append("z" if value != ord("z") else "y")
        elif op is K.ANY:
            out.append("x")
        elif op is K.IN:
            out.append(_member(value))
        elif op is K.SUBPATTERN:
            out.append(_text(value[3], gap))
        elif op is K.BRANCH:
            out.append(_text(value[1][0], gap))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, _, body = value
            out.append(_text(body, gap) * low if low or body[0][0] is not K.ANY else gap)
    return "".join(out)


def _member(items):
    accept = re.compile("[" + "".join(
        {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_SPACE: r"\s", K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_SPACE: r"\S",
         K.CATEGORY_NOT_WORD: r"\W", K.CATEGORY_NOT_DIGIT: r"\D"}[v] if op is K.CATEGORY else
        "^" if op is K.NEGATE else re.escape(chr(v)) if op is K.LITERAL else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}"
        for op, v in items) + "]", re.ASCII)
    return next(ch for ch in " 7a-zZ_:;.,'\"/=" + "".join(map(chr, range(33, 127))) + "\n" if accept.match(ch))


def _sample(rule):
    """A text the pattern matches, made from the pattern itself."""
    parsed = regex_parser.parse(rule["match"])
    for text in (_text(parsed, gap) for gap in ("", " ", " 1 ")):
        if re.search(rule["match"], text, re.ASCII):
            return text
    return None


@pytest.fixture(scope="module")
def samples():
    out = {}
    for rule in load_catalogue():
        text = _sample(rule)
        assert text is not None, rule["name"]
        out[rule["ordinal"]] = text
    return out


def test_required_literals_are_in_every_sample(samples):
    for rule in load_catalogue():
        text = samples.get(rule["ordinal"])
        wanted = patterns.required_literals(rule["match"])
        if text is not None and wanted:
            folded = re.sub("[0-9]", "0", text.lower())
            assert any(w in folded for w in wanted), (rule["name"], wanted, text)


def test_every_rule_finds_its_sample(spark, samples):
    rules = [{**r, "min_entropy": None} for r in load_catalogue()]
    rows = spark.createDataFrame([(str(k), v) for k, v in samples.items()], "id string, text string")
    found = {(r.id, r.ordinal) for r in match_counts(rows, build_index(rules)).collect()}
    missing = [rules[k]["name"] for k in samples if (str(k), k) not in found]
    assert missing == []


def test_plain_prose_is_quiet(spark, content):
    rules = [r for p in ("pii", "security_hardening", "secrets", "finance", "healthcare") for r in load_pack(p)]
    rules = [{"ordinal": i, **r} for i, r in enumerate(rules)]
    assert match_counts(content("A quiet evening by the river, and nothing else."), rules).count() == 0


def test_dialects():
    assert patterns.to_java(r"a$") == r"(?d)a\z"
    assert patterns.to_java(r"[$]\$") == r"(?d)[$]\$"
    assert patterns.to_re2(r"^a$") == r"^a\z"
    assert r"\b" not in patterns.to_java(r"\bx\b") and r"\b" in patterns.to_java(r"\bx\b", unicode=True)


def test_catalogue_tables(spark):
    rules = catalog.rules_frame(spark, load_catalogue())
    assert catalog.categories(rules).count() == 32
    stats = {r.category: r.total for r in catalog.statistics(rules).collect()}
    assert stats["pii"] == 39 and sum(stats.values()) == 620
    assert {r.name for r in catalog.search(rules, "ROUTING").collect()} == {"bank-routing-number", "aba-routing-number"}
    assert catalog.filter_category(rules, ["web-development"]).count() == 12
    assert catalog.filter_env_only(rules).count() == 617
    assert catalog.validate(rules).count() == 0
    assert [r.problem for r in catalog.validate(rules, version=1).collect()] == ["bundle version 1"]
    again = catalog.collect_rules(rules)
    assert [r["match"] for r in again] == [r["match"] for r in load_catalogue()]


def test_merge_keeps_pack_order(spark):
    packs = [catalog.rules_frame(spark, [{"ordinal": i, **r} for i, r in enumerate(load_pack(p))]) for p in ("arm", "container")]
    merged = catalog.merge_packs(*packs).orderBy("ordinal").collect()
    assert [r.ordinal for r in merged] == list(range(6)) and merged[0].category == "arm" and merged[5].category == "container"


def test_overrides(spark):
    rules = catalog.rules_frame(spark, load_catalogue(["container", "arm"]))
    off = spark.createDataFrame([("container", False)], "category string, enabled boolean")
    one = spark.createDataFrame([("dockerfile-privileged-mode", True)], "name string, enabled boolean")
    kept = catalog.filter_enabled(catalog.apply_overrides(rules, one, off))
    assert {r.name for r in kept.collect()} >= {"dockerfile-privileged-mode"} and kept.count() == 3
    assert catalog.filter_enabled(catalog.apply_overrides(rules, one, off), include_disabled=True).count() == 6


def test_checksum_follows_the_rules(spark):
    rules = load_catalogue(["arm"])
    one = catalog.bundle_metadata(catalog.rules_frame(spark, rules)).first()
    two = catalog.bundle_metadata(catalog.rules_frame(spark, [{**rules[0], "severity": "low"}, *rules[1:]])).first()
    assert one.pattern_count == 2 and one.schema_version == 2 and one.checksum != two.checksum


def test_bad_rules_do_not_stop_a_scan(spark, content, rule):
    from siftwarden.operators import catalog
    from siftwarden.plans import scan
    rules = catalog.rules_frame(spark, [rule("a", r"\d+", 0), rule("b", "(", 1), rule("a", "x", 2), rule("c", "", 3), rule("d", "y", 4)])
    refused = []
    found = scan.scan_rule_table(content("12 xy"), rules, refused).collect()
    assert {r.rule for r in found} == {"a", "d"} and [n for n, _ in refused] == ["b", "a", "c"]
    told = {(r.rule, r.problem.split(":")[0]) for r in catalog.validate(rules).collect()}
    assert told == {("a", "duplicate name"), ("b", "does not compile"), ("c", "empty pattern")}
