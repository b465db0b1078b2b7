"""Whole scans, put together from the operators."""

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import filters, risk
from ..operators.catalog import collect_rules, split_compilable
from ..operators.detect import active_rules, candidates, detect, match_counts
from ..operators.suppress import suppress_baseline, suppress_inline
from ..plans.rule_index import build_index
from ..sources.tables import IGNORE_FILES, diff_files, diff_files_of, list_tree, read_diff_lines, read_ignore_files, read_tree, tree_files


def scan_table(content, rules, profile=None, baseline=None, scope=None, **options) -> DataFrame:
    """Findings of a content table under a profile, without suppressed and known ones."""
    if profile is not None:
        rules, content = profile.rules(rules), profile.content(content)
    findings = detect(content, rules, **options)
    if scope is not None:
        findings = suppress_inline(findings, content, scope)
    return suppress_baseline(findings, baseline) if baseline is not None else findings


def scan_rule_table(content, rules, refused=None, **options) -> DataFrame:
    """Findings for a rule *table* in one pass over the content; the table has to fit on the driver.

    A rule that cannot be used does not stop the scan: it is left out, and ``refused``, a list, gets its
    (name, problem).
    """
    usable, bad = split_compilable(collect_rules(rules))
    if refused is not None:
        refused += [(r["name"], r["problem"]) for r in bad]
    return detect(content, usable, **options)


def scan_files(spark, path, rules, size_limit=filters.DEFAULT_SIZE_LIMIT, globs=(), skip_binary=True,
               use_ignore_files=True, ignore_files=IGNORE_FILES, **options):
    """(findings, stats) of a file tree, or of several (a list of roots).

    Paths and sizes are decided on the listing alone; content is read for the files that remain.  With
    ``use_ignore_files`` the fixed directories, the globs and those in the ignore files of each root exclude
    files; a root's own globs act on its own files, on their whole paths.
    """
    one = lambda df, metric: df.select(F.lit(metric).alias("metric"), F.lit("").alias("key"), F.lit(1).cast("long").alias("n"))
    binary = F.expr(filters.is_binary_bytes("content"))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1)).alias("key")
    content, stats, uneven = None, None, False
    for root in [path] if isinstance(path, str) else path:
        own = (*globs, *read_ignore_files(spark, root, ignore_files)) if use_ignore_files else ()
        keep = (lambda p, own=own: filters.not_ignored(p, own)) if use_ignore_files else None
        files = list_tree(spark, root)
        small = read_tree(spark, root, size_limit, keep=keep, files=files)
        # the listing alone for totals and sizes, one look into the first bytes for the rest
        if skip_binary:
            seen = read_tree(spark, root, size_limit, keep=keep, files=files, head=filters.BINARY_WINDOW).select("path", binary.alias("binary"))
        else:
            seen = tree_files(files, size_limit, keep).select("path", F.lit(False).alias("binary"))
        seen = seen.groupBy("binary", extension).agg(F.count(F.lit(1)).alias("n"))
        told = F.when(F.col("binary"), F.array(
            F.struct(F.lit("skipped_binary").alias("metric"), F.lit("").alias("key"), "n"))).otherwise(F.array(
                F.struct(F.lit("files_scanned").alias("metric"), F.lit("").alias("key"), "n"),
                F.struct(F.lit("files_by_extension").alias("metric"), "key", "n")))
        counted = one(files, "files_total").unionByName(
            one(tree_files(files, keep=keep).where(F.col("length") > size_limit), "skipped_size")).unionByName(seen.select(F.inline(told)))
        uneven = uneven or "content" in files.columns
        content = small if content is None else content.unionByName(small)
        stats = counted if stats is None else stats.unionByName(counted)
    readable = content.where(~binary) if skip_binary else content
    content = readable.select(F.col("path").alias("id"), F.expr("decode(content, 'UTF-8')").alias("text"))
    # files that tasks have listed come in tasks of bounded size already
    findings = detect(content, rules, **{"spread_input": uneven, **options})
    return findings, stats.groupBy("metric", "key").agg(F.sum("n").alias("value"))


RUN_SCHEMA = "name string, started timestamp, duration_ms bigint, files bigint, bytes bigint, skipped bigint, findings bigint"


def run_scan(content, rules, folder, name="scan", size_limit=filters.DEFAULT_SIZE_LIMIT):
    """Count the matches of a content table, as one run: (counts, stats), and a row more in ``folder/scan_runs``.

    The text is read once: what is scanned and skipped is observed on the way, matches are written as (id, ordinal,
    matches), and statistics by severity and category are summed from these.  ``stats`` has (metric, key, value).
    """
    spark, index = content.sparkSession, build_index(active_rules(rules))
    skipped = f"(octet_length(text) > {size_limit} or {filters.is_binary()})"
    seen = Observation()
    started = dt.datetime.now()
    # looked at once a row: the metrics keep the column from being evaluated again
    observed = content.where("text is not null").withColumn("_skipped", F.expr(skipped)).observe(
        seen, F.count(F.lit(1)).alias("rows_total"), F.expr("count_if(not _skipped)").alias("rows_scanned"),
        F.expr("count_if(_skipped)").alias("rows_skipped"),
        F.expr("coalesce(sum(if(_skipped, 0, octet_length(text))), 0)").alias("bytes_scanned"))
    path = f"{folder}/counts/{uuid.uuid4()}"
    match_counts(observed.where("not _skipped"), index).write.parquet(path)
    took = dt.datetime.now() - started
    counts = spark.read.parquet(path)
    metrics = seen.get
    totals = spark.createDataFrame([(k, "", metrics[k]) for k in ("rows_total", "rows_scanned", "rows_skipped", "bytes_scanned")],
                                   "metric string, key string, value bigint")
    found = risk.finding_stats(counts, index)
    run = found.where("metric = 'findings'").groupBy().agg(F.coalesce(F.sum("value"), F.lit(0)).alias("findings")).select(
        F.lit(name).alias("name"), F.lit(started).alias("started"), F.lit(took // dt.timedelta(milliseconds=1)).cast("bigint").alias("duration_ms"),
        F.lit(metrics["rows_scanned"]).alias("files"), F.lit(metrics["bytes_scanned"]).alias("bytes"),
        F.lit(metrics["rows_skipped"]).alias("skipped"), "findings")
    run.write.mode("append").parquet(f"{folder}/scan_runs")
    return counts, totals.unionByName(found)


def read_runs(spark, folder) -> DataFrame:
    """The runs written by ``run_scan``, one row each."""
    return spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/scan_runs")


def scan_diff(diffs, rules, **options) -> DataFrame:
    """Findings in the added lines of (diff_id, diff) rows; ``id`` is the file."""
    return detect(diff_files(diffs), rules, **options)


def scan_diff_files(spark, path, rules, **options) -> DataFrame:
    """Findings in the added lines of diff files, which may be larger than a row; ``id`` is the file."""
    return detect(diff_files_of(read_diff_lines(spark, path)), rules, **options)


def scan_kv(settings, rules, **options) -> DataFrame:
    """Findings in (source, key, value) settings.

    Rules meant for settings and the secrets rules apply, once per key and rule, and the entropy
    floor is taken on the whole value.
    """
    from ..session import spread

    chosen = [r for r in active_rules(rules, env=True) if r["env_var"] or r["category"] == "secrets"]
    index = build_index(chosen)
    content = settings.select(F.col("source").alias("id"), "key", F.col("value").alias("text"))
    hits = candidates(spread(content), index).where(F.expr("text rlike pattern"))
    hits = hits.where(f"min_entropy is null or {scalars.shannon_entropy('text')} >= min_entropy")
    return hits.join(F.broadcast(index.metadata(settings.sparkSession)), "ordinal").select(
        "id", "key", "rule", "category", "severity", "confidence", F.lit(1).alias("line"),
        F.lit(0).cast("bigint").alias("start_byte"), F.col("text").alias("matched"),
        F.concat_ws("=", "key", "text").alias("content"), "description", F.lit("entropy").alias("kind"),
        F.expr(scalars.fingerprint("rule", "id", "1", "text")).alias("fingerprint"))


def scan_requests(requests, rules) -> DataFrame:
    """Risk of every request row (id, text), with or without a finding."""
    index = build_index(active_rules(rules))
    graded = risk.graded_counts(match_counts(requests, index), index)
    return risk.risk_by_source(graded, requests)
