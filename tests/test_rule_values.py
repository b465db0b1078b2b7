"""Rules whose alternatives must not be merged: leftmost alternative first, blanks as they stand."""

import pytest

from siftwarden import load_catalogue, match_counts, match_spans
from siftwarden.operators.detect import detect
from siftwarden.plans import patterns

RULES = {r["name"]: r for r in load_catalogue()}
CASES = [
    ("email-address", "a@b.com|org", ["a@b.com|org"]),
    ("vue-template-injection", ":href=\"'/x/' + request\"", None),
    ("elasticsearch-config", "elasticsearch to elasticsearch", 2),
    ("helm-release", "HelmRelease a HelmRelease b", 2),
    ("helm-repo", "helm repo add && helm repo update", 2),
    ("etcd-service", "etcd client and peer", ["etcd client"]),
    ("n-plus-one-query", "for (x) { query(); db. }", ["for (x) { query"]),
    ("regex-in-loop", "for { new RegExp; a..test( }", ["for { new RegExp"]),
    ("ai-placeholder", "[INSERT YOUR_NAME]", ["[INSERT YOUR"]),
    ("container-privileged", "privileged : true", []),
    ("k8s-allow-privilege-escalation", "allowPrivilegeEscalation : true", []),
    ("k8s-run-as-non-root", "runAsNonRoot : false", []),
    ("ai-overexplanation", "let  me explain", []),
]


@pytest.mark.parametrize(("name", "text", "want"), CASES)
def test_alternatives(content, name, text, want):
    found = [r.matched for r in match_spans(content(text), [{**RULES[name], "min_entropy": None, "env_var": False}]).collect()]
    if want is None:
        assert len(found) == 1
    elif isinstance(want, int):
        assert len(found) == want
    else:
        assert found == want


TEXTS = ["ΟΔΟΣ 12", "ſtraße é", "STRASSE", "straße", "KELVIN 7", "kelvin 5", "İstanbul", "istanbul", "x1 ١٢٣", "Éa 9", "éA 9", "user=bob", "AB-12", "z"]
PATTERNS = ["ΟΔΟΣ", "(?i)οδος", "(?i)straße", "(?i)kelvin", "(?i)kelvin \\d", "(?i)éa", "\\d\\d\\d", "[[:alpha:]]+ [[:digit:]]", "(?P<who>user)=\\w+",
            r"\p{Lu}\p{Lu}-\d", r"bob\z", r"\x{41}B", "a(?i)B", "(?<u_n>bob)", "(?i)istanbul"]


@pytest.mark.parametrize("unicode", [False, True])
def test_gate_drops_nothing(content, rule, unicode):
    from pyspark.sql import functions as F
    rules = [rule(f"r{i}", p, i) for i, p in enumerate(PATTERNS)]
    df = content(*TEXTS)
    got = {(r.id, r.ordinal) for r in match_counts(df, rules, unicode).collect()}
    for i, p in enumerate(PATTERNS):
        want = {r.id for r in df.filter(F.col("text").rlike(patterns.to_java(p, unicode))).collect()}
        assert {d for d, o in got if o == i} == want, p
    assert got


def test_patterns_that_neither_engine_reads(content, rule):
    assert patterns.compile_error("(") and patterns.compile_error(r"\p{Nonsense}") and patterns.compile_error("")
    assert detect(content("user=bob"), [rule("named", "(?P<who>user)=(?P<name_2>\\w+)")]).count() == 1
