"""Removing findings: inline directives, baselines, duplicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import spread

KEYWORD = "scan:ignore"
ALL_RULES = "*"


def directives(content, keyword=KEYWORD) -> DataFrame:
    """(id, line, rule, at_start) of every directive; a bare one has rule ``*``.

    A directive follows ``//``, ``#`` or ``/*`` and one blank.  ``/*`` has to close on its line.
    The directives are matched in the text as it is; their lines come from the running totals.
    """
    word = keyword.replace(":", "[:]")
    rule = "(?:[:][ \\t]*([^ \\t*\\r\\n]+))?"
    body = rf"^([^\n]*?)(?://|#|(/\*)) {word}[ \t]*{rule}[ \t]*(\*/)?[ \t]*"
    pattern = F.lit(rf"(?dm){body}(?=\r?$)")
    found = spread(content.where(F.col("text").contains(keyword)).select("id", "text")).select(
        "id", "text", F.regexp_extract_all("text", pattern, F.lit(0)).alias("found")).withColumn(
        "gaps", F.split("text", rf"(?dm){body}(?=\r?$)", -1))
    rows = found.select("id", F.inline(F.expr(f"if(size(found) > 0, {text.spans('gaps', 'found')}, array())")))
    part = lambda k: F.regexp_extract("matched", rf"(?d){body}\z", k)
    parts = rows.select("id", "line", part(1).alias("lead"), part(2).alias("opened"), part(3).alias("rule"),
                        part(4).alias("closed")).where("opened = '' or closed <> ''")
    return parts.select("id", F.col("line").cast("int").alias("line"),
                        F.when(F.col("rule") == "", ALL_RULES).otherwise(F.col("rule")).alias("rule"),
                        (F.trim(F.translate("lead", "\t", " ")) == "").alias("at_start"))


def suppressions(content, scope="same_line", keyword=KEYWORD) -> DataFrame:
    """(id, line, rule) that a scope takes out.

    ``same_line``: a directive that begins its line, rule named, acts on that line.
    ``trailing``: a directive behind code acts on its line; bare means all rules.
    ``next_line``: a directive that begins its line acts on the line below; bare means all rules.
    """
    found = directives(content, keyword)
    if scope == "same_line":
        kept = found.where(F.col("at_start") & (F.col("rule") != ALL_RULES))
    elif scope == "trailing":
        kept = found
    elif scope == "next_line":
        kept = found.where("at_start").withColumn("line", F.col("line") + 1)
    else:
        raise ValueError(f"scope is same_line, trailing or next_line, not {scope!r}")
    return kept.select("id", "line", "rule").distinct()


def suppression_list(content, keyword=KEYWORD) -> DataFrame:
    """Directives found, counted by rule."""
    return directives(content, keyword).groupBy("rule").agg(
        F.count("*").alias("directives"), F.countDistinct("id").alias("sources"))


def suppress_inline(findings, content, scope="same_line", keyword=KEYWORD) -> DataFrame:
    """Drop findings on suppressed lines."""
    taken = suppressions(content, scope, keyword).select(
        F.col("id").alias("s_id"), F.col("line").alias("s_line"), F.col("rule").alias("s_rule"))
    here = (F.col("id") == F.col("s_id")) & (F.col("line") == F.col("s_line"))
    named = (F.col("s_rule") == F.col("rule")) | (F.col("s_rule") == ALL_RULES)
    return findings.join(taken, here & named, "left_anti")


def suppress_baseline(findings, baseline) -> DataFrame:
    """Drop findings whose fingerprint is known; Spark broadcasts a small baseline by itself."""
    return findings.join(baseline.select("fingerprint"), "fingerprint", "left_anti").select(*findings.columns)


BASELINE_BUCKETS = 64


def baseline_table(spark, name, buckets=BASELINE_BUCKETS) -> DataFrame:
    """A baseline kept as a table bucketed by fingerprint: (fingerprint, batch); made if it is not there."""
    if not spark.catalog.tableExists(name):
        empty = spark.createDataFrame([], "fingerprint string, batch bigint")
        empty.write.bucketBy(buckets, "fingerprint").sortBy("fingerprint").format("parquet").saveAsTable(name)
    return spark.table(name)


def suppress_known(findings, name, batch) -> DataFrame:
    """Findings that are in no *other* batch of a bucketed baseline; only the findings are shuffled."""
    known = baseline_table(findings.sparkSession, name).where(F.col("batch") != batch).select("fingerprint")
    return findings.join(known.hint("merge"), "fingerprint", "left_anti").select(*findings.columns)


def extend_baseline(findings, name, batch, buckets=BASELINE_BUCKETS):
    """Append the fingerprints of a batch that the baseline does not have; a repeated batch adds nothing."""
    known = baseline_table(findings.sparkSession, name, buckets)
    fresh = findings.select("fingerprint").distinct().join(known.select("fingerprint").hint("merge"), "fingerprint", "left_anti")
    fresh = fresh.withColumn("batch", F.lit(batch).cast("bigint"))
    fresh.write.mode("append").bucketBy(buckets, "fingerprint").sortBy("fingerprint").format("parquet").saveAsTable(name)
    findings.sparkSession.catalog.refreshTable(name)


def create_baseline(findings) -> DataFrame:
    return findings.select("fingerprint").distinct()


def read_baseline(spark, path) -> DataFrame:
    """Baseline from JSON: an array of strings, an array of findings, or lines of either, or bare lines.

    Read line by line, so a large baseline is split like any text; an array may stand on one line, or
    have its items, or the fields of its items, on lines of their own.
    """
    line = F.trim("value")
    listed = F.from_json(line, "array<string>")
    items = F.when(line.startswith("[") & line.endswith("]"), listed).otherwise(
        F.array(F.trim(F.regexp_replace(line, r"^\[|\s*[,\]]\s*$", ""))))
    item = F.col("item")
    field = F.regexp_extract("item", r'^"fingerprint"\s*:\s*(".*")$', 1)
    quoted = F.from_json(F.concat(F.lit("["), F.when(field != "", field).otherwise(item), F.lit("]")), "array<string>")
    found = F.when(item.startswith("{"), F.get_json_object("item", "$.fingerprint")).when(
        item.startswith('"'), quoted[0]).when(~item.rlike(r"^[\[\]{}]"), item)
    rows = spark.read.text(path).select(F.explode(items).alias("item")).select(found.alias("fingerprint"))
    return rows.where("fingerprint <> ''").distinct()


def dedup(findings) -> DataFrame:
    """One finding per fingerprint: the one with the lowest offset."""
    first = F.min_by(F.struct(*findings.columns), F.struct("start_byte", "end_byte")).alias("f")
    return findings.groupBy(F.col("fingerprint").alias("k")).agg(first).select("f.*")


def baseline_diff(findings, baseline) -> DataFrame:
    """(fingerprint, status): new, unchanged or resolved."""
    now = findings.select("fingerprint").distinct().withColumn("now", F.lit(True))
    then = baseline.select("fingerprint").distinct().withColumn("then", F.lit(True))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return now.join(then, "fingerprint", "full_outer").select("fingerprint", status.alias("status"))
