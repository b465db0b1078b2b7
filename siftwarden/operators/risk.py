"""Statistics and weighted risk.

Everything works on graded rows ``(id, category, severity, confidence, n)``, where ``n`` is a
number of findings: one per finding, or a whole row-and-rule count, so that risk does not need
the matches themselves.  Scores are summed as integers in hundredths, which makes the per-category
truncation exact and independent of the order of summation.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import materialize


def graded(findings) -> DataFrame:
    """Graded rows from findings."""
    return findings.select("id", "category", "severity", "confidence", F.lit(1).cast("bigint").alias("n"))


def graded_counts(counts, rules) -> DataFrame:
    """Graded rows from ``match_counts``; ``rules`` is the rule index."""
    return counts.join(F.broadcast(rules.metadata(counts.sparkSession)), "ordinal").select(
        "id", "rule", "category", "severity", "confidence", F.col("matches").cast("bigint").alias("n"))


def _units():
    return F.expr(f"n * {scalars.severity_weight('severity')} * {scalars.confidence_tenths('confidence')} "
                  f"* {scalars.category_tenths('category')}")


def weight_tables(spark, severity_weights=None, category_weights=None):
    """Caller weights as (severity, weight) and (category, weight) tables; empty means default."""
    severity = spark.createDataFrame(list((severity_weights or {}).items()), "severity string, sw int") \
        if severity_weights else None
    category = spark.createDataFrame([(k, str(v)) for k, v in (category_weights or {}).items()],
                                     "category string, cw string") if category_weights else None
    return severity, category


def _weighted(rows, severity_weights=None, category_weights=None):
    """(id, category, severity, n, weight, units); units are hundredths of a point."""
    spark = rows.sparkSession
    severity, category = weight_tables(spark, severity_weights, category_weights)
    if severity is None and category is None:
        return rows.select("id", "category", "severity", "n",
                           F.expr(scalars.severity_weight("severity")).alias("weight"), _units().alias("units"))
    if severity is not None:
        rows = rows.join(F.broadcast(severity), "severity", "left").withColumn("weight", F.coalesce("sw", F.lit(1)))
    else:
        rows = rows.withColumn("weight", F.expr(scalars.severity_weight("severity")))
    if category is not None:
        rows = rows.join(F.broadcast(category), "category", "left").withColumn(
            "tenths", F.coalesce(F.col("cw").cast("decimal(12,4)"), F.lit(1).cast("decimal(12,4)")) * 10)
    else:
        rows = rows.withColumn("tenths", F.expr(scalars.category_tenths("category")).cast("decimal(12,4)"))
    units = F.expr(f"cast(n * weight * {scalars.confidence_tenths('confidence')} as decimal(20,0)) * tenths")
    return rows.select("id", "category", "severity", "n", "weight", units.alias("units"))


GRADES = ["critical", "high", "medium", "low"]


def _per_category(weighted, *keys):
    of_grade = [F.coalesce(F.sum(F.when(F.col("severity") == g, F.col("n"))), F.lit(0)).alias(f"n_{g}") for g in GRADES]
    return weighted.groupBy(*keys, "category").agg(
        F.sum("units").alias("units"), F.sum("n").alias("n"), *of_grade,
        F.max(F.struct("weight", "severity")).alias("top"))


def _summary(per_category, *keys):
    truncated = F.sum(F.expr("cast(units div 100 as bigint)"))
    total = per_category.groupBy(*keys).agg(
        F.coalesce(truncated, F.lit(0)).cast("int").alias("score"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("finding_count"),
        F.max("top").alias("top"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct(
            "category", (F.col("units") / 100).cast("double").alias("score"), "n")))).alias("parts"),
        *[F.coalesce(F.sum(f"n_{g}"), F.lit(0)).alias(f"n_{g}") for g in GRADES],
    )
    by_severity = F.create_map(*[x for g in GRADES for x in (F.lit(g), F.col(f"n_{g}"))])
    return total.select(
        *keys, "score", F.expr(scalars.risk_level("score")).alias("level"), "finding_count",
        F.when(F.col("finding_count") > 0, F.col("top.severity")).alias("highest_severity"),
        F.map_from_entries(F.transform("parts", lambda p: F.struct(
            p["category"], F.struct(p["score"].alias("score"), p["n"].alias("n"))))).alias("by_category"),
        F.map_filter(by_severity, lambda _, n: n > 0).alias("by_severity"),
    )


def risk_score(rows, severity_weights=None, category_weights=None) -> DataFrame:
    """One row for the whole table: score, level, counts, highest severity, breakdowns by category and severity."""
    return _summary(_per_category(_weighted(rows, severity_weights, category_weights)))


def risk_by_source(rows, sources=None, severity_weights=None, category_weights=None) -> DataFrame:
    """Risk per id.  ``sources`` (id) adds the ids without a finding, with score 0.

    The extra ids go through the same aggregation as zero rows: no join, and a hot id is
    combined before the shuffle.
    """
    weighted = _weighted(rows, severity_weights, category_weights)
    if sources is not None:
        units = weighted.schema["units"].dataType
        weighted = weighted.unionByName(sources.select(
            "id", F.lit("").alias("category"), F.lit(None).cast("string").alias("severity"),
            F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("weight"), F.lit(0).cast(units).alias("units")))
    return _summary(_per_category(weighted, "id"), "id")


def risk_by_category(rows, severity_weights=None, category_weights=None) -> DataFrame:
    per = _per_category(_weighted(rows, severity_weights, category_weights))
    return per.select("category", (F.col("units") / 100).cast("double").alias("score"),
                      F.col("n").alias("finding_count"))


def risk_by_source_category(rows) -> DataFrame:
    """(id, category, score): the untruncated points."""
    return _per_category(_weighted(rows), "id").select("id", "category", (F.col("units") / 100).alias("score"))


def findings_by_severity(rows) -> DataFrame:
    return rows.groupBy("severity").agg(F.sum("n").alias("findings"))


def severity_cube(rows) -> DataFrame:
    """Counts by category and severity with both marginals and the total."""
    return rows.cube("category", "severity").agg(F.sum("n").alias("findings"))


def highest_severity(rows, *keys) -> DataFrame:
    weight = F.expr(scalars.severity_weight("severity"))
    return rows.groupBy(*keys).agg(F.max(F.struct(weight.alias("w"), "severity")).alias("top")).select(
        *keys, F.col("top.severity").alias("highest_severity"))


def rule_hits(counts, rules) -> DataFrame:
    """(rule, rows, matches)."""
    rows = graded_counts(counts, rules)
    return rows.groupBy("rule").agg(F.countDistinct("id").alias("rows"), F.sum("n").alias("matches"))


# Action by (level, kind of risk), priority by level; None covers the other kinds.
_ACTIONS = {
    "none": {None: "none"},
    "low": {"secrets": "review", None: "none"},
    "medium": {"secrets": "fix", "security": "fix", "compliance": "compliance_review", None: "review"},
    "high": {"secrets": "block", "security": "block", "compliance": "compliance_review", None: "fix"},
    "critical": {None: "block"},
}
_PRIORITIES = {"none": 5, "low": 4, "medium": 3, "high": 2, "critical": 1}
RISK_KINDS = ["secrets", "security", "code-quality", "performance", "compliance", "configuration", "informational"]

# Ours: which kind of risk a rule category is.
KIND_OF_CATEGORY = {
    "secrets": "secrets",
    **dict.fromkeys(["pii", "security-hardening", "web-security", "ai-safety", "llm-guardrails", "supply-chain",
                     "git-ops", "frameworks"], "security"),
    **dict.fromkeys(["code-quality", "accessibility", "web_development", "git-hygiene", "data_visualization",
                     "shift-left", "api_integration", "pwa"], "code-quality"),
    "performance": "performance",
    **dict.fromkeys(["compliance", "healthcare", "finance"], "compliance"),
    **dict.fromkeys(["devops", "infrastructure", "cloud-native", "kubernetes", "terraform", "container", "graphql",
                     "cloudformation", "arm"], "configuration"),
    **dict.fromkeys(["ai-detection", "metadata"], "informational"),
}


def action_table(spark) -> DataFrame:
    """(level, kind, action, priority): 35 rows."""
    rows = [(level, kind, by.get(kind, by[None]), _PRIORITIES[level])
            for level, by in _ACTIONS.items() for kind in RISK_KINDS]
    return spark.createDataFrame(rows, "level string, kind string, action string, priority int")


def kind_table(spark) -> DataFrame:
    return spark.createDataFrame(list(KIND_OF_CATEGORY.items()), "category string, kind string")


def risk_action(categories) -> DataFrame:
    """Add kind, level, action and priority to rows of (…, category, score)."""
    spark = categories.sparkSession
    level = F.expr(scalars.risk_level("cast(floor(score) as bigint)"))
    kinds = categories.join(F.broadcast(kind_table(spark)), "category", "left").withColumns({
        "kind": F.coalesce("kind", F.lit("informational")), "level": level})
    return kinds.join(F.broadcast(action_table(spark)), ["level", "kind"])


def scan_stats(content, counts, rules, size_limit=None) -> DataFrame:
    """(metric, key, value) rows of one scan; such rows of several scans can be added up."""
    from . import filters

    limit = size_limit or filters.DEFAULT_SIZE_LIMIT
    skipped = f"(octet_length(text) > {limit} or {filters.is_binary()})"
    base = content.agg(
        F.count("*").alias("rows_total"), F.expr(f"count_if(not {skipped})").alias("rows_scanned"),
        F.expr(f"count_if({skipped})").alias("rows_skipped"),
        F.expr(f"coalesce(sum(if({skipped}, 0, octet_length(text))), 0)").alias("bytes_scanned"))
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("bigint").alias("value"))
                      for c in ("rows_total", "rows_scanned", "rows_skipped", "bytes_scanned")])
    return base.select(F.inline(pairs)).unionByName(finding_stats(counts, rules))


def finding_stats(counts, rules) -> DataFrame:
    """(metric, key, value) rows of match counts: in all, by severity, by category."""
    rows = graded_counts(counts, rules)
    sets = F.array(
        F.struct(F.lit("findings").alias("metric"), F.lit("").alias("key")),
        F.struct(F.lit("findings_by_severity").alias("metric"), F.col("severity").alias("key")),
        F.struct(F.lit("findings_by_category").alias("metric"), F.col("category").alias("key")))
    return rows.groupBy("severity", "category").agg(F.sum("n").alias("n")).select(
        F.inline(sets), "n").groupBy("metric", "key").agg(F.sum("n").alias("value"))


def stats_merge(*parts) -> DataFrame:
    """Add partial statistics: counters by metric, maps by metric and key."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("metric", "key").agg(F.sum("value").alias("value"))


def throughput(runs) -> DataFrame:
    """Averages by name over ``scan_runs`` rows; a run without duration counts as 0."""
    seconds = F.col("duration_ms") / 1000
    rate = lambda c: F.when(F.col("duration_ms") > 0, c / seconds).otherwise(F.lit(0.0))
    rated = runs.select("name", "duration_ms", "findings", rate(F.col("files")).alias("fps"),
                        rate(F.col("bytes") / (1024 * 1024)).alias("mps"))
    return rated.groupBy("name").agg(
        F.count("*").alias("runs"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.avg("fps").alias("files_per_second"), F.avg("mps").alias("mb_per_second"),
        F.sum("findings").alias("findings"))


def density_band(x):
    return f"case when {x} >= 10 then 'high' when {x} >= 5 then 'elevated' when {x} >= 2 then 'moderate' else 'low' end"


def finding_density(rows, content) -> DataFrame:
    """Findings per 1,000 lines of each id, with a band."""
    from ..functions import text

    lined = content.select("id", F.expr(text.line_count("text")).cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("n"))
    both = lined.unionByName(rows.select("id", F.lit(0).cast("bigint").alias("lines"), "n"))
    total = both.groupBy("id").agg(F.sum("lines").alias("lines"), F.sum("n").alias("findings"))
    density = F.when(F.col("lines") > 0, F.col("findings") * 1000.0 / F.col("lines")).otherwise(0.0)
    return total.withColumn("density", density).withColumn("band", F.expr(density_band("density")))


def rank_findings(findings, span=65_536) -> DataFrame:
    """Rank in each id by severity, then position.

    A source with very many findings is not sorted in one task: findings are numbered inside
    (severity, stretch of ``span`` bytes) buckets, and the sizes of the buckets before give the
    offset.  Only the bucket sizes of a source meet in one window.
    """
    from pyspark.sql import Window

    weight = F.expr(scalars.severity_weight("severity"))
    bucketed = materialize(findings.withColumns({"_w": -weight, "_b": F.floor(F.col("start_byte") / span)}))
    sizes = bucketed.groupBy("id", "_w", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("id").orderBy("_w", "_b")) - F.col("_n")
    offsets = sizes.select("id", "_w", "_b", before.alias("_before"))
    inside = Window.partitionBy("id", "_w", "_b").orderBy("start_byte", "end_byte", "rule")
    numbered = bucketed.withColumn("_i", F.row_number().over(inside))
    return numbered.join(offsets, ["id", "_w", "_b"]).select(
        *findings.columns, (F.col("_before") + F.col("_i")).alias("position"))


def top_risk_sources(risk, k=20) -> DataFrame:
    return risk.orderBy(F.col("score").desc(), "id").limit(k)


def findings_union(*tables) -> DataFrame:
    """Findings of all kinds in one table."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    return merged
