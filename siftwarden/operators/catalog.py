"""The rule catalogue as a table: merge, validate, normalize, filter, list.

Detection compiles a catalogue on the driver (``collect_rules``), everything else here is plain DataFrame work.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import patterns
from ..schema import RULE_SCHEMA

BUNDLE_VERSION = 2
COLUMNS = [f.name for f in RULE_SCHEMA.fields]


def rules_frame(spark, rules) -> DataFrame:
    """Rule dictionaries as a table."""
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rules], RULE_SCHEMA)


def collect_rules(rules) -> list:
    """Rule table as dictionaries, for the detection plan: the catalogue is what has to fit on the driver."""
    return [{**r.asDict(), "tags": list(r["tags"] or [])} for r in rules.select(*COLUMNS).orderBy("ordinal").toLocalIterator()]


def merge_packs(*packs) -> DataFrame:
    """Concatenate packs in the order given; the order becomes the ordinal.

    Each pack is shifted by the ordinals of the packs before it: one row per pack is ordered, not the rules.
    """
    merged = packs[0].withColumn("pack", F.lit(0))
    for i, p in enumerate(packs[1:], 1):
        merged = merged.unionByName(p.withColumn("pack", F.lit(i)))
    sizes = merged.groupBy("pack").agg((F.max("ordinal") + 1).alias("size"))
    shift = sizes.select("pack", (F.sum("size").over(Window.orderBy("pack")) - F.col("size")).cast("int").alias("shift"))
    shifted = merged.join(F.broadcast(shift), "pack")
    return shifted.withColumn("ordinal", F.col("ordinal") + F.col("shift")).drop("pack", "shift")


def normalize(rules) -> DataFrame:
    """Lower-case grades with their aliases; an unknown grade becomes medium."""
    return rules.withColumns({
        "severity": F.expr(scalars.normalize_severity("severity")),
        "confidence": F.expr(scalars.normalize_confidence("confidence")),
    })


def validate(rules, version=BUNDLE_VERSION) -> DataFrame:
    """(rule, problem) rows: bundle version, duplicate names, empty patterns, patterns that do not compile."""
    copies = rules.groupBy("name").count().where("count > 1").select(
        F.col("name").alias("rule"), F.lit("duplicate name").alias("problem"))
    empty = rules.where("match is null or match = ''").select(
        F.col("name").alias("rule"), F.lit("empty pattern").alias("problem"))
    return copies.unionByName(empty).unionByName(_compile_problems(rules)).unionByName(
        _problems(rules.sparkSession, [("*", f"bundle version {version}")] if version != BUNDLE_VERSION else []))


def _problems(spark, rows):
    return spark.createDataFrame(rows, "rule string, problem string")


def _compile_problems(rules):
    """Distinct patterns are compiled on the driver, as detection does."""
    told = {r["match"]: patterns.compile_error(r["match"]) for r in rules.where("match <> ''").select("match").distinct().toLocalIterator()}
    bad = rules.sparkSession.createDataFrame([(m, f"does not compile: {p}") for m, p in told.items() if p], "match string, problem string")
    return rules.join(F.broadcast(bad), "match").select(F.col("name").alias("rule"), "problem")


def split_compilable(rules) -> tuple:
    """(usable, refused) rule dictionaries; a refused rule carries its ``problem``.

    Refused are rules without a pattern, with one that does not compile, and, of rules of one name, all but the first.
    """
    usable, refused, names = [], [], set()
    for rule in rules:
        problem = "empty pattern" if not rule["match"] else patterns.compile_error(rule["match"])
        if problem is None and rule["name"] in names:
            problem = "duplicate name"
        if problem is None:
            names.add(rule["name"])
            usable.append(rule)
        else:
            refused.append({**rule, "problem": problem})
    return usable, refused


def dead_rules(rules) -> list:
    """(name, highest possible entropy, floor) of rules whose floor no match can reach."""
    from math import log2

    dead = []
    for rule in rules:
        if rule["min_entropy"] is None or patterns.compile_error(rule["match"]):
            continue
        longest = patterns.longest_match(rule["match"])
        if log2(longest) < rule["min_entropy"]:
            dead.append((rule["name"], round(log2(longest), 3), rule["min_entropy"]))
    return dead


def category_key(x):
    """Categories compare with hyphens and underscores alike."""
    return f"replace(lower({x}), '_', '-')"


def filter_category(rules, categories) -> DataFrame:
    wanted = [c.lower().replace("_", "-") for c in categories]
    return rules.where(F.expr(category_key("category")).isin(wanted))


def filter_severity(rules, minimum) -> DataFrame:
    """Also for findings: at least this severity."""
    return rules.where(f"{scalars.severity_rank('severity')} >= {scalars.severity_rank(_text(minimum))}")


def filter_confidence(rules, minimum) -> DataFrame:
    return rules.where(f"{scalars.confidence_rank('confidence')} >= {scalars.confidence_rank(_text(minimum))}")


def filter_env_only(rules) -> DataFrame:
    """Leave out rules that are meant for settings."""
    return rules.where("not env_var")


def override_severity(rules, overrides) -> DataFrame:
    """``overrides`` is a (category, severity) table; also for findings."""
    new = overrides.select(F.expr(category_key("category")).alias("k"), F.col("severity").alias("new_severity"))
    joined = rules.withColumn("k", F.expr(category_key("category"))).join(F.broadcast(new), "k", "left")
    return joined.withColumn("severity", F.coalesce("new_severity", "severity")).select(*rules.columns)


def apply_overrides(rules, by_rule=None, by_category=None) -> DataFrame:
    """Switch rules on or off: (name, enabled) beats (category, enabled) beats the definition."""
    out = rules
    if by_category is not None:
        k = by_category.select(F.expr(category_key("category")).alias("k"), F.col("enabled").alias("c_enabled"))
        out = out.withColumn("k", F.expr(category_key("category"))).join(F.broadcast(k), "k", "left").drop("k")
    else:
        out = out.withColumn("c_enabled", F.lit(None).cast("boolean"))
    if by_rule is not None:
        r = by_rule.select("name", F.col("enabled").alias("r_enabled"))
        out = out.join(F.broadcast(r), "name", "left")
    else:
        out = out.withColumn("r_enabled", F.lit(None).cast("boolean"))
    return out.withColumn("enabled", F.coalesce("r_enabled", "c_enabled", "enabled")).select(*rules.columns)


def filter_enabled(rules, include_disabled=False) -> DataFrame:
    return rules if include_disabled else rules.where("enabled")


def listing(rules, category=None, include_disabled=True) -> DataFrame:
    out = filter_enabled(rules, include_disabled)
    out = filter_category(out, [category]) if category else out
    return out.select("name", "category", "severity", "confidence", "enabled", "description").orderBy("name")


def categories(rules) -> DataFrame:
    return rules.select("category").distinct().orderBy("category")


def search(rules, needle) -> DataFrame:
    text = needle.lower()
    return rules.where(F.lower("name").contains(text) | F.lower("description").contains(text))


def statistics(rules) -> DataFrame:
    """Rules per category and severity."""
    grades = ["critical", "high", "medium", "low"]
    counts = rules.groupBy("category").pivot("severity", grades).count().na.fill(0, grades)
    return counts.withColumn("total", sum(F.col(g) for g in grades))


def bundle_metadata(rules, version=BUNDLE_VERSION, created_at=None) -> DataFrame:
    """One row: version, time, rule count, and SHA-256 over all fields of the rules in their order.

    The rules meet in one row, as they do in a bundle; that bounds this to catalogues.
    """
    plain = [F.coalesce(F.col(c).cast("string") if c != "tags" else F.array_join("tags", ","), F.lit("")) for c in COLUMNS]
    lines = F.array_sort(F.collect_list(F.struct("ordinal", "name", F.concat_ws("\u001f", *plain).alias("line"))))
    return rules.agg(F.count("*").alias("pattern_count"), lines.alias("lines")).select(
        F.lit(version).alias("schema_version"), F.lit(created_at).cast("string").alias("created_at"), "pattern_count",
        F.sha2(F.array_join(F.transform("lines", lambda r: r.line), "\n"), 256).alias("checksum"))


def _text(value):
    return "'" + value.replace("'", "''") + "'"
