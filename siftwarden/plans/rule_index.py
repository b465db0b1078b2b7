"""Compile a rule list into the gate pattern and the rule index, which Spark joins as its size allows."""

from bisect import bisect_left
from dataclasses import dataclass
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from . import patterns

INDEX_SCHEMA = ("gate_key string, gate_keys array<string>, ordinal int, pattern string, "
                "min_entropy double")


@dataclass(frozen=True)
class RuleIndex:
    """What detection needs to know of a catalogue; small and built on the driver."""

    rules: tuple
    gate: str | None
    rows: tuple
    has_entropy: bool
    has_many_keys: bool
    has_always: bool
    unicode: bool = False

    def frame(self, spark) -> DataFrame:
        """(gate_key, ordinal, pattern, ...) as a local relation."""
        table = pa.table({
            "gate_key": pa.array([r[0] for r in self.rows], pa.string()),
            "gate_keys": pa.array([list(r[1]) for r in self.rows], pa.list_(pa.string())),
            "ordinal": pa.array([r[2] for r in self.rows], pa.int32()),
            "pattern": pa.array([r[3] for r in self.rows], pa.string()),
            "min_entropy": pa.array([r[4] for r in self.rows], pa.float64()),
        })
        return spark.createDataFrame(table)

    def metadata(self, spark) -> DataFrame:
        """(ordinal, rule, category, ...) as a local relation."""
        names = ["name", "category", "severity", "confidence", "description", "reference"]
        columns = {"ordinal": pa.array([r["ordinal"] for r in self.rules], pa.int32())}
        for name in names:
            columns["rule" if name == "name" else name] = pa.array(
                [r[name] for r in self.rules], pa.string())
        columns["tags"] = pa.array([r["tags"] for r in self.rules], pa.list_(pa.string()))
        return spark.createDataFrame(pa.table(columns))


def _with_prefix(vocabulary, prefix):
    """Members of the sorted vocabulary that begin with the prefix."""
    start = bisect_left(vocabulary, prefix)
    return takewhile(lambda v: v.startswith(prefix), islice(vocabulary, start, None))


def build_index(rules, unicode=False) -> RuleIndex:
    gates = {}
    for rule in rules:
        problem = patterns.compile_error(rule["match"])
        if problem:
            raise ValueError(f"rule {rule['name']!r}: {problem}")
        gates[rule["ordinal"]] = patterns.required_literals(rule["match"], unicode)
    vocabulary = sorted({lit for lits in gates.values() for lit in lits})
    rows, many = [], False
    for rule in rules:
        wanted = gates[rule["ordinal"]]
        # the gate reports the longest literal at a position, which implies its prefixes
        keys = sorted({v for w in wanted for v in _with_prefix(vocabulary, w)}) if wanted else [""]
        many = many or len(keys) > 1
        java = patterns.to_java(rule["match"], unicode)
        rows += [(key, tuple(keys), rule["ordinal"], java, rule["min_entropy"]) for key in keys]
    return RuleIndex(
        rules=tuple(rules),
        gate=patterns.gate_pattern(vocabulary) if vocabulary else None,
        rows=tuple(rows),
        has_entropy=any(r["min_entropy"] is not None for r in rules),
        has_many_keys=many,
        has_always=any(not g for g in gates.values()),
        unicode=unicode,
    )
