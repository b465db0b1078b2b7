"""The scan as a stream: stateless detection, bounded deduplication, windows, a static baseline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import suppress
from ..operators.detect import detect


def stream_detect(stream, rules, **options) -> DataFrame:
    """Findings of an unbounded (ts, id, text) table: the batch plan, no state.

    Columns besides ``id`` and ``text`` (the event time) are kept.
    """
    return detect(stream, rules, **options)


def stream_dedup(findings, horizon="1 hour", ts="ts") -> DataFrame:
    """Drop fingerprints seen within the horizon; state is bounded by the watermark."""
    return findings.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def once_per_window(findings, window="1 hour", lateness="10 minutes", ts="ts") -> DataFrame:
    """One finding per fingerprint and window of event time, whatever the triggers; adds ``window_start``.

    Unlike ``stream_dedup`` the result does not depend on how the input is cut into batches.  A window's
    fingerprints leave the state when the watermark passes its end; rows that come later are dropped.
    """
    timed = findings.withWatermark(ts, lateness) if findings.isStreaming else findings
    # the window carries the watermark on; a stream has one event time only
    spans = timed.withColumn("span", F.window(ts, window)).withColumn(ts, F.expr(f"{ts} + interval 0 seconds"))
    once = spans.dropDuplicates(["fingerprint", "span"])
    return once.withColumn("window_start", F.expr("span.start + interval 0 seconds")).drop("span")


def late_rows(query):
    """Rows that a finished query's state refused as older than its watermark, as its progress tells.

    Aggregations count what is left of them after the sums inside a task.
    """
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def _hundredths():
    return F.expr(f"{scalars.severity_weight('severity')} * {scalars.confidence_tenths('confidence')} "
                  f"* {scalars.category_tenths('category')}")


def risk_windows(findings, window="1 hour", slide=None, session_gap=None, lateness="10 minutes", ts="ts") -> DataFrame:
    """Findings and risk points per tumbling, sliding or session window; for streams and tables.

    Points are kept in hundredths, per category, so that windows can be added up exactly.
    """
    span = F.session_window(ts, session_gap) if session_gap else F.window(ts, window, slide or window)
    timed = findings.withWatermark(ts, lateness) if findings.isStreaming else findings
    return timed.groupBy(span.alias("span"), "category").agg(
        F.count("*").alias("findings"), F.sum(_hundredths()).alias("hundredths")).select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
        "category", "findings", "hundredths")


def write_new_findings(findings, read_baseline, path, checkpoint, trigger=None):
    """Write findings whose fingerprint is not in the baseline.

    ``read_baseline()`` is called for every batch, so the baseline may change while the stream runs.
    Each batch has its own directory, which a repeated batch overwrites.
    """
    def keep_new(batch, batch_id):
        fresh = batch.join(read_baseline(), "fingerprint", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = findings.writeStream.foreachBatch(keep_new).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_unseen_findings(findings, table, path, checkpoint, trigger=None):
    """Write findings whose fingerprint no earlier batch had; the baseline is a bucketed table that grows by batch.

    A batch is compared with the other batches only, so one that is repeated after a failure writes the same rows.
    """
    def keep_new(batch, batch_id):
        fresh = suppress.suppress_known(batch, table, batch_id)
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        suppress.extend_baseline(batch, table, batch_id)

    writer = findings.writeStream.foreachBatch(keep_new).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_findings(findings, path, checkpoint, trigger=None):
    """Append findings as Parquet, exactly once per input row."""
    writer = findings.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)
