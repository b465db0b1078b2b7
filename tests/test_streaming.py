import datetime as dt

from siftwarden.operators import suppress
from siftwarden.operators.detect import detect
from siftwarden.rules import load_catalogue
from siftwarden.streaming import streams

SCHEMA = "ts timestamp, id string, text string"
RULES = [r for r in load_catalogue(["pii"]) if r["name"] in ("email-address", "ssn")]
T0 = dt.datetime(2024, 1, 1)


def write(spark, path, *rows):
    data = [(T0 + dt.timedelta(minutes=m), i, t) for m, i, t in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(path))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


ROWS = [(0, "a", "x@y.org"), (5, "b", "nothing"), (20, "a", "x@y.org"), (70, "c", "123-45-6789\nq@r.org")]


def test_stream_equals_batch(spark, tmp_path):
    for row in ROWS:
        write(spark, tmp_path / "in", row)
    live = streams.stream_detect(stream(spark, tmp_path / "in"), RULES)
    streams.write_findings(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = detect(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), RULES)
    columns = ["id", "rule", "line", "start_byte", "matched", "fingerprint", "ts"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    assert got == sorted(map(tuple, batch.select(columns).collect())) and len(got) == 4


def test_dedup_within_horizon(spark, tmp_path):
    for row in ROWS:
        write(spark, tmp_path / "in", row)
    live = streams.stream_dedup(streams.stream_detect(stream(spark, tmp_path / "in", 10), RULES), "1 hour")
    assert sorted(r.fingerprint for r in run(live, "deduped").collect()) == [
        "email-address:a:1:x@y.org", "email-address:c:2:q@r.org", "ssn:c:1:123-45-6789"]


def test_windows_match_the_batch_twin(spark, tmp_path):
    for row in [*ROWS, (300, "z", "end@of.org")]:
        write(spark, tmp_path / "in", row)
    live = streams.risk_windows(streams.stream_detect(stream(spark, tmp_path / "in", 10), RULES), "1 hour")
    batch = streams.risk_windows(detect(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), RULES), "1 hour")
    got = {tuple(r) for r in run(live, "windows", "append").collect()}
    want = {tuple(r) for r in batch.collect() if r.window_start < T0 + dt.timedelta(hours=4)}
    assert got == want and len(want) == 2
    sliding = streams.risk_windows(detect(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), RULES), "1 hour", "30 minutes")
    assert sliding.count() > batch.count()
    session = streams.risk_windows(detect(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), RULES), session_gap="30 minutes")
    assert {r.findings for r in session.collect()} == {1, 2}


def test_late_rows_are_dropped(spark, tmp_path):
    for row in [(0, "a", "x@y.org"), (300, "b", "b@y.org"), (301, "b", "c@y.org"), (1, "late", "late@y.org"), (900, "e", "e@y.org")]:
        write(spark, tmp_path / "in", row)
        import time
        time.sleep(1.1)  # file order is by modification time
    live = streams.risk_windows(streams.stream_detect(stream(spark, tmp_path / "in"), RULES), "1 hour", lateness="10 minutes")
    first = [r for r in run(live, "late").collect() if r.window_start == T0]
    assert [r.findings for r in first] == [1]


def test_baseline_in_a_stream(spark, tmp_path):
    for row in ROWS:
        write(spark, tmp_path / "in", row)
    known = suppress.create_baseline(detect(spark.createDataFrame([("a", "x@y.org")], "id string, text string"), RULES))
    known.write.parquet(str(tmp_path / "base"))
    live = streams.stream_detect(stream(spark, tmp_path / "in"), RULES)
    q = streams.write_new_findings(live, lambda: spark.read.parquet(str(tmp_path / "base")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c", "c"]


def test_events_arrive_in_files_and_late_ones_are_counted(spark):
    from conftest import SF
    from siftwarden import registry
    rows, late = registry.arriving(spark, SF, lambda found: streams.risk_windows(found, "1 hour"), files=3)
    want = streams.risk_windows(detect(registry.timed_events(spark, SF), registry.PII), "1 hour")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) and late > 0


def test_once_per_window_does_not_depend_on_batches(spark, tmp_path):
    rows = [(m, i, "x@y.org") for m, i in ((0, "a"), (20, "a"), (50, "b"), (70, "a"), (71, "a"), (130, "a"))]
    for row in rows:
        write(spark, tmp_path / "in", row)
    found = {}
    for files in (1, 10):
        live = streams.once_per_window(streams.stream_detect(stream(spark, tmp_path / "in", files), RULES), "1 hour", "3 hours")
        found[files] = sorted((r.fingerprint, r.window_start) for r in run(live, f"once{files}").collect())
    assert found[1] == found[10] and len(found[1]) == 4


def test_bucketed_baseline_grows_by_batch(spark, tmp_path):
    """Each fingerprint is written once over all batches; a repeated batch changes nothing; the baseline is not shuffled."""
    name = f"known_{tmp_path.name}"
    for row in [(0, "a", "x@y.org"), (1, "a", "x@y.org"), (2, "b", "q@r.org"), (3, "a", "x@y.org")]:
        write(spark, tmp_path / "in", row)
    live = streams.stream_detect(stream(spark, tmp_path / "in"), RULES)
    streams.write_unseen_findings(live, name, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == ["a", "b"]
    batch = detect(spark.createDataFrame([("b", "q@r.org"), ("c", "c@d.org")], "id string, text string"), RULES)
    before = spark.table(name).count()
    for _ in range(2):
        # batch 7 is repeated: the same findings come out, and the table has its row once
        assert [r.id for r in suppress.suppress_known(batch, name, 7).collect()] == ["c"]
        suppress.extend_baseline(batch, name, 7)
        assert spark.table(name).count() == before + 1
    plan = suppress.suppress_known(batch, name, 8)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin"):]
    baseline = [line for line in side.splitlines() if "known_" in line or "Exchange" in line]
    assert sum("Exchange hashpartitioning(fingerprint" in line for line in baseline) <= 1
    spark.sql(f"drop table {name}")


def test_parts_of_events_are_dealt_over_files(spark, tmp_path, monkeypatch):
    """A trigger's events come in as many files as their number asks for, and none of them is late."""
    from conftest import SF
    from siftwarden import registry
    monkeypatch.setattr(registry, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(registry, "EVENTS_A_FILE", 25)
    rows, _ = registry.arriving(spark, SF, lambda found: streams.risk_windows(found, "6 hours"), files=2)
    want = streams.risk_windows(detect(registry.timed_events(spark, SF), registry.PII), "6 hours")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    parts = [len(list(p.glob("*.parquet"))) for p in sorted(next(tmp_path.iterdir()).joinpath("in").iterdir())]
    assert parts[:2] == [spark.read.parquet(f"{SF}/events.parquet").count() // 2 // 25] * 2 and len(parts) == 5
