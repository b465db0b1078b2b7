"""Sinks: rule bundles, findings tables, JSON, SARIF, report lines, file trees."""

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import materialize, spread
from ..operators.catalog import BUNDLE_VERSION, COLUMNS

TOOL_NAME = "siftwarden"
TOOL_VERSION = "0.1.0"
SARIF_VERSION = "2.1.0"

# Results of one SARIF document; a source with more gets several documents.
RESULTS_PER_DOCUMENT = 5_000


def write_bundle(rules, path, created_at=None):
    """Catalogue as a versioned gzip JSON bundle (one file: a catalogue is small)."""
    fields = [c for c in COLUMNS if c != "ordinal"]
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", *fields)))
    patterns = F.transform(ordered, lambda r: F.struct(*[r[c].alias(c) for c in fields]))
    bundle = rules.agg(F.to_json(F.struct(
        F.lit(BUNDLE_VERSION).alias("schema_version"),
        F.lit(str(created_at or int(time.time()))).alias("created_at"), patterns.alias("patterns"))).alias("value"))
    bundle.coalesce(1).write.mode("overwrite").option("compression", "gzip").text(path)


def write_findings(findings, path, mode="overwrite", run=None):
    """Findings as Parquet, one directory per category.

    Rows are gathered by category, and partitions are split and joined by size at run time, so a
    category with most of the findings is written by as many tasks as its size asks for.  With a ``run``
    the rows go below a directory of that run, which a second write of the run replaces as a whole; other
    runs stay, and reading ``path`` gives all of them with a column ``run``.
    """
    target = path if run is None else f"{path}/run={run}"
    findings.hint("rebalance", "category").write.mode(mode).partitionBy("category").parquet(target)


FINDING_FIELDS = ["id", "rule", "category", "severity", "confidence", "line", "start_byte", "end_byte", "matched", "matched_len",
                  "description", "reference", "tags", "kind", "fingerprint"]


def findings_json(findings) -> DataFrame:
    """(id, json): one JSON object per finding."""
    columns = [c for c in findings.columns if c != "ordinal"]
    return findings.select("id", F.to_json(F.struct(*columns)).alias("json"))


def findings_documents(findings, per_document=RESULTS_PER_DOCUMENT) -> DataFrame:
    """(id, part, document): ``{findings, stats}`` as one JSON document per source, of about so many findings each.

    ``stats`` counts the document's findings, in all and by severity and category; parts come from a hash of the
    fingerprint, as in ``sarif_documents``, and their statistics can be added up.
    """
    findings = materialize(findings.select(*FINDING_FIELDS))
    parts = findings.groupBy("id").agg(F.ceil(F.count("*") / per_document).alias("parts"))
    placed = findings.join(parts, "id").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))

    def by(column):
        counts = placed.groupBy("id", "part", column).agg(F.count("*").alias("n"))
        return counts.groupBy("id", "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}"))

    rows = placed.groupBy("id", "part").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "rule", F.struct(*FINDING_FIELDS).alias("f")))), lambda r: r.f).alias("findings"))
    told = rows.join(by("severity"), ["id", "part"]).join(by("category"), ["id", "part"])
    stats = F.struct(F.size("findings").cast("long").alias("findings"), "by_severity", "by_category")
    return told.select("id", "part", F.to_json(F.struct("findings", stats.alias("stats"))).alias("document"))


def stats_json(stats) -> DataFrame:
    """One JSON object of the (metric, key, value) rows; the rows are few."""
    rows = F.array_sort(F.collect_list(F.struct("metric", "key", "value")))
    return stats.agg(F.to_json(F.struct(rows.alias("stats"))).alias("json"))


def sarif_rules(findings) -> DataFrame:
    """(id, name, severity) of every rule that has a finding."""
    return findings.groupBy(F.col("rule").alias("id")).agg(
        F.first("rule").alias("name"), F.min_by("severity", F.struct("start_byte", "fingerprint")).alias("severity"))


def sarif_results(findings) -> DataFrame:
    """(id, fingerprint, result): the SARIF result object of each finding."""
    region = F.struct(F.col("line").alias("startLine"), (F.col("start_byte") + 1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("id").alias("uri")).alias("artifactLocation"),
                              region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule").alias("ruleId"), F.expr(scalars.sarif_level("severity")).alias("level"),
        F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("id", "fingerprint", "rule", "severity", result.alias("result"))


def sarif_documents(findings, per_document=RESULTS_PER_DOCUMENT) -> DataFrame:
    """(id, part, document): SARIF logs per source, of about ``per_document`` results each.

    The parts come from a hash of the fingerprint, so no source has to fit into one group.
    """
    findings = materialize(findings.select("id", "fingerprint", "rule", "severity", "line", "start_byte", "description"))
    results = sarif_results(findings)
    parts = findings.groupBy("id").agg(F.ceil(F.count("*") / per_document).alias("parts"))
    placed = results.join(parts, "id").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    collected = placed.groupBy("id", "part").agg(
        F.array_sort(F.collect_set(F.struct(F.col("rule").alias("id"), F.col("rule").alias("name"),
                                            F.struct(F.expr(scalars.sarif_level("severity")).alias("level")
                                                     ).alias("defaultConfiguration")))).alias("rules"),
        F.array_sort(F.collect_list(F.struct("fingerprint", "result"))).alias("results"))
    driver = F.struct(F.lit(TOOL_NAME).alias("name"), F.lit(TOOL_VERSION).alias("version"), "rules")
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"),
                   F.transform("results", lambda r: r["result"]).alias("results"))
    return collected.select("id", "part", F.to_json(F.struct(
        F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))).alias("document"))


def report_lines(findings) -> DataFrame:
    """(id, headline, matched_line): the lines a person reads."""
    headline = F.format_string("[%s] %s at %s:%d:%d", F.upper("severity"), "rule", "id", "line", "start_byte")
    return findings.select("id", headline.alias("headline"), F.concat(
        F.lit("Matched: "), F.expr(scalars.truncated("matched"))).alias("matched_line"))


def write_tree(rows, path, folder=None):
    """Write the ``text`` of each row as a file of its own that ends in a line break; with ``folder``, a directory a value of that column.

    On a local file system Spark's writer starts processes for each file to set its permissions, so there the tasks write
    the files themselves, in a directory a task.  A task that is repeated writes the same files again.
    """
    spark = rows.sparkSession
    by = F.col(folder).cast("string") if folder else F.lit(None).cast("string")
    rows = spread(rows.select(by.alias(folder or "folder"), F.col("text").cast("string").alias("text")))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    if target.getScheme() != "file":
        writer = rows.write.partitionBy(folder) if folder else rows.select("text").write
        writer.option("maxRecordsPerFile", 1).text(path)
        return
    root = target.getPath()

    def write(batches):
        import os
        from urllib.parse import quote

        import pyarrow as pa
        from pyspark import TaskContext

        task, number, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for value, text in zip(batch.column("folder").to_pylist(), batch.column("text").to_pylist()):
                value = quote(value, safe=" ") if value else "__HIVE_DEFAULT_PARTITION__"
                place = f"{root}/{folder}={value}/part-{task:05d}" if folder else f"{root}/part-{task:05d}"
                if place not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                with open(f"{place}/{number:08d}.txt", "wb") as file:
                    file.write((text or b"") + b"\n")
                number += 1
        yield pa.record_batch({"files": pa.array([number], pa.int64())})

    files = rows.select(F.col(folder or "folder").alias("folder"), F.col("text").cast("binary").alias("text"))
    files.mapInArrow(write, "files bigint").write.format("noop").mode("append").save()
