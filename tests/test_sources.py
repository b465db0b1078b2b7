import gzip
import json

from siftwarden.operators import catalog
from siftwarden.operators.detect import detect
from siftwarden.plans import scan
from siftwarden.rules import load_catalogue
from siftwarden.sources import sinks, tables


def test_bundle_round_trip(spark, tmp_path):
    rules = catalog.rules_frame(spark, load_catalogue())
    sinks.write_bundle(rules, str(tmp_path / "b"), created_at=7)
    assert any(p.name.endswith(".txt.gz") for p in (tmp_path / "b").iterdir())
    read = tables.read_rules(spark, str(tmp_path / "b"))
    assert tables.bundle_version(spark, str(tmp_path / "b")) == 2
    plain = [{k: v for k, v in r.items()} for r in catalog.collect_rules(read)]
    assert plain == load_catalogue()


def test_plain_and_other_key_forms(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([
        {"name": "a", "category": "c", "match_pattern": "x", "severity": "crit", "minEntropy": 3.5},
        {"name": "b", "category": "c", "match": "y", "enabled": False}]))
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        f.write((tmp_path / "r.json").read_text())
    for name in ("r.json", "g.json.gz"):
        a, b = catalog.collect_rules(catalog.normalize(tables.read_rules(spark, str(tmp_path / name))))
        assert (a["match"], a["severity"], a["min_entropy"], a["enabled"]) == ("x", "critical", 3.5, True)
        assert (b["match"], b["severity"], b["enabled"]) == ("y", "medium", False)


def test_yaml_lists(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(
        "# rules\n- name: key-id\n  category: secrets\n  match: '\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b'\n  enabled: true\n"
        "  severity: high\n  confidence: high\n  minEntropy: 3.5\n  description: 'it''s a key'\n  tags:\n    - secrets\n    - aws\n"
        "- name: broken\n  category: x\n  match: \"(\"\n  severity: low\n  confidence: low\n  description: bad\n")
    rules = catalog.collect_rules(tables.read_rule_lists(spark, str(tmp_path)))
    usable, refused = catalog.split_compilable(rules)
    assert [r["name"] for r in usable] == ["key-id"] and refused[0]["name"] == "broken"
    assert usable[0]["tags"] == ["secrets", "aws"] and usable[0]["description"] == "it's a key" and usable[0]["min_entropy"] == 3.5


def test_settings(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": 2}'), (2, "{}"), (3, "not json")], "k int, props string")
    assert {tuple(r) for r in tables.kv_from_json(df, "k", "props").collect()} == {("1", "a", "x"), ("1", "b", "2")}
    kv = spark.createDataFrame([("s", "TOKEN", "ghp_" + "a1B2c3D4e5F6g7H8i9J0kLmNoPqRsTuVwXyZ"), ("s", "MAIL", "a@b.org")],
                               "source string, key string, value string")
    found = scan.scan_kv(kv, load_catalogue()).collect()
    assert {(r.key, r.rule) for r in found} == {("TOKEN", "secrets-github-token")}
    assert found[0].content.startswith("TOKEN=ghp_") and found[0].line == 1 and found[0].kind == "entropy"


DIFF = """diff --git a/x b/x
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@
 kept 111-11-1111
-gone 222-22-2222
+one
+ssn 333-33-3333
--- a/y
+++ /dev/null
+never 444-44-4444
+++ b/x.py
+ssn 555-55-5555
+++ c/z.py
+
+ssn 666-66-6666"""


def test_diffs(spark):
    df = spark.createDataFrame([("d", DIFF), ("e", "no header\n+ssn 777-77-7777")], "diff_id string, diff string")
    lines = [(r.file, r.line) for r in tables.diff_lines(df).orderBy("pos").collect()]
    assert lines == [("x.py", "one"), ("x.py", "ssn 333-33-3333"), ("x.py", "ssn 555-55-5555"), ("c/z.py", ""), ("c/z.py", "ssn 666-66-6666")]
    found = scan.scan_diff(df, load_catalogue(["pii"])).where("rule = 'ssn'").collect()
    assert {(r.id, r.line, r.matched) for r in found} == {
        ("x.py", 2, "333-33-3333"), ("x.py", 3, "555-55-5555"), ("c/z.py", 2, "666-66-6666")}


def test_file_tree(spark, tmp_path):
    for name, body in {"a/x.md": b"ssn 123-45-6789", "b.log": b"ssn 123-45-6789", "bin.dat": b"\x00\x01\x02ssn 123-45-6789",
                       "node_modules/y.md": b"ssn 123-45-6789", "big.md": b"z" * 5000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    findings, stats = scan.scan_files(spark, str(tmp_path), load_catalogue(["pii"]), size_limit=1000, globs=["*.log"])
    assert {r.id.rsplit("/", 2)[-1] for r in findings.where("rule = 'ssn'").collect()} == {"x.md"}
    got = {(r.metric, r.key): r.value for r in stats.collect()}
    assert got == {("files_total", ""): 5, ("files_scanned", ""): 1, ("skipped_binary", ""): 1, ("skipped_size", ""): 1,
                   ("files_by_extension", "md"): 1}
    plan = tables.read_tree(spark, str(tmp_path), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan.replace(" ", "")


def test_exports(spark, content, tmp_path):
    rows = content("password: secret123 x@y.org", "x@y.org " * 7)
    found = detect(rows, load_catalogue(["pii"])).where("rule = 'email-address'")
    one = json.loads(sinks.findings_json(found).where("id = 'd0'").first().json)
    assert one["rule"] == "email-address" and one["start_byte"] == 20
    docs = [json.loads(r.document) for r in sinks.sarif_documents(found, per_document=3).collect()]
    assert all(d["version"] == "2.1.0" for d in docs) and sum(len(d["runs"][0]["results"]) for d in docs) == 8
    result = docs[0]["runs"][0]["results"][0]
    assert result["level"] == "note" and "startLine" in result["locations"][0]["physicalLocation"]["region"]
    assert sinks.sarif_rules(found).collect()[0].id == "email-address"
    line = sinks.report_lines(found).where("id = 'd0'").first()
    assert line.headline == "[LOW] email-address at d0:1:20" and line.matched_line == "Matched: x@y.org"
    sinks.write_findings(found, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 8 and (tmp_path / "f" / "category=pii").is_dir()


def test_requests(spark, content):
    got = {r.id: (r.score, r.level) for r in scan.scan_requests(content("hello", "password = 'hunter22'"), load_catalogue(["pii"])).collect()}
    assert got["d0"] == (0, "none") and got["d1"][0] > 0


def test_large_rule_table(spark, content, rule):
    rules = catalog.rules_frame(spark, [rule(f"r{i}", f"w{i}x", i) for i in range(3000)])
    rows = content(" ".join(f"w{i}x" for i in range(0, 3000, 7)))
    found = scan.scan_rule_table(rows, rules)
    assert sorted(r.matched for r in found.collect()) == sorted(f"w{i}x" for i in range(0, 3000, 7))


def test_scan_table(spark, content):
    from siftwarden.plans import profiles
    rows = content("mail a@b.org // scan:ignore:email-address\nmail c@d.org", "x@y.org\0")
    found = scan.scan_table(rows, load_catalogue(), profiles.preset("production"), scope="trailing")
    assert [r.matched for r in found.where("rule = 'email-address'").collect()] == ["c@d.org"]


def test_ignore_files_of_several_roots(spark, tmp_path):
    """Each root has its own globs; what they exclude is not read, even if it is gone by then."""
    for root in ("one", "two"):
        (tmp_path / root / "src").mkdir(parents=True)
        for name in ("a.txt", "b.log", "src/c.txt", "src/d.tmp"):
            (tmp_path / root / name).write_text(f"mail {name.replace('/', '.')}@{root}.org\n")
    (tmp_path / "one" / ".scanignore").write_text("# logs\n*.log\n\n!b.log\n")
    (tmp_path / "one" / ".gitignore").write_text("*/src/*.tmp\n")
    (tmp_path / "two" / ".gitignore").write_text("*/src/*\n")
    roots = [str(tmp_path / r) for r in ("one", "two")]
    findings, stats = scan.scan_files(spark, roots, load_catalogue(["pii"]))
    for gone in ("one/b.log", "one/src/d.tmp", "two/src/c.txt", "two/src/d.tmp"):
        (tmp_path / gone).unlink()
    found = {r.matched for r in findings.where("rule = 'email-address'").collect()}
    assert found == {"a.txt@one.org", "src.c.txt@one.org", "a.txt@two.org", "b.log@two.org"}
    assert scan.scan_files(spark, roots, load_catalogue(["pii"]), use_ignore_files=False)[1].where(
        "metric = 'files_scanned'").first().value == 4
    (tmp_path / "one" / ".scanignore").write_text("x" * (2 << 20))
    try:
        scan.scan_files(spark, roots, load_catalogue(["pii"]))
    except ValueError:
        pass
    else:
        raise AssertionError("a large ignore file is refused")


def test_runs_are_recorded_and_rated(spark, tmp_path):
    from siftwarden.operators import risk
    content = spark.createDataFrame([("a", "x@y.org 123-45-6789"), ("b", "\0binary"), ("c", "z" * 200), ("d", None)], "id string, text string")
    for _ in range(2):
        counts, stats = scan.run_scan(content, load_catalogue(["pii"]), str(tmp_path), "pii", size_limit=100)
    rows = {(r.metric, r.key): r.value for r in stats.collect()}
    assert (rows["rows_total", ""], rows["rows_scanned", ""], rows["rows_skipped", ""], rows["bytes_scanned", ""]) == (3, 1, 2, 19)
    assert rows["findings", ""] == sum(r.matches for r in counts.collect()) > 0
    runs = scan.read_runs(spark, str(tmp_path))
    assert [(r.runs, r.findings) for r in risk.throughput(runs).collect()] == [(2, 2 * rows["findings", ""])]
    assert {(r.files, r.bytes, r.skipped) for r in runs.collect()} == {(1, 19, 2)}


def test_diffs_larger_than_a_split(spark, tmp_path):
    """Headers are carried over splits of 64 bytes; the rows are those of the diff as one row."""
    import random
    from siftwarden.sources import tables
    rng = random.Random(3)
    parts = ["--- a/x", "+++ b/one.py", "+++ b/two.py\r", "+++ /dev/null", "+added line of some length here", "+", "-removed", " kept", "+++ a/three.py", "+é 日本\r"]
    for i in range(3):
        (tmp_path / f"d{i}.diff").write_bytes("\n".join(rng.choices(parts, k=200)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = tables.read_diff_lines(spark, str(tmp_path))
        got = {(r.diff_id[-7:], r.id, r.text) for r in tables.diff_files_of(lines).collect()}
        assert lines.select("split").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = spark.createDataFrame([(f"d{i}.diff", (tmp_path / f"d{i}.diff").read_bytes().decode()) for i in range(3)], "diff_id string, diff string")
    assert got == {(r.diff_id, r.id, r.text) for r in tables.diff_files(whole).collect()} and len(got) == 9


def test_tree_sink_writes_a_file_a_row_without_processes(spark, tmp_path):
    """Files are written by the tasks, many at once; Spark's writer starts two processes a file, 2.4 ms each at eight cores."""
    rows = spark.range(600).selectExpr("cast(id as string) as text", "if(id % 3 = 0, null, concat('l', id % 3)) as lang")
    sinks.write_tree(rows, str(tmp_path / "flat"))
    sinks.write_tree(rows, str(tmp_path / "by"), folder="lang")
    for name in ("flat", "by"):
        files = tables.read_tree(spark, str(tmp_path / name))
        assert sorted(int(r.content) for r in files.collect()) == list(range(600))
        assert {r.length for r in files.where("length < 3").collect()} == {2}
    assert not list((tmp_path / "flat").rglob("*.crc"))
    assert {p.name for p in (tmp_path / "by").iterdir()} == {"lang=l1", "lang=l2", "lang=__HIVE_DEFAULT_PARTITION__"}
    assert sum(1 for _ in (tmp_path / "by" / "lang=l1").rglob("*.txt")) == 200


def test_diffs_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """The diffs of all documents do not pass one task."""
    from conftest import SF
    from siftwarden import registry
    monkeypatch.setattr(registry, "shared_folder", lambda spark: str(tmp_path))
    found = registry.QUERIES["detect_diff_files"](spark, SF).count()
    want = registry.QUERIES["detect_diff"](spark, SF).count()
    assert found == want > 0 and len(list(tmp_path.rglob("part-*.txt"))) > 1


def small_tree(root, folders=40, files=50):
    for i in range(folders):
        (root / f"d{i % 7}" / f"e{i}").mkdir(parents=True)
        for j in range(files):
            (root / f"d{i % 7}" / f"e{i}" / f"{j}.txt").write_text(f"{i * files + j}\n")


def test_a_tree_is_listed_and_dealt_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no file of a tree, and tasks go by what is read: before, all 2,000 files were inputs of the plan, in 63 tasks."""
    small_tree(tmp_path)
    monkeypatch.setattr(tables, "ENTRIES_A_TASK", 5, raising=False)
    files = tables.list_tree(spark, str(tmp_path))
    assert len(files.inputFiles()) < 200
    read = tables.read_tree(spark, str(tmp_path), files=files)
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    rows = read.collect()
    assert sorted(int(r.content) for r in rows) == list(range(2000))
    for r in rows:
        assert r.path.startswith(f"file:{tmp_path}/d") and r.length == len(r.content)
    monkeypatch.setattr(tables, "BYTES_A_TASK", 200)
    assert tables.read_tree(spark, str(tmp_path), files=files).rdd.getNumPartitions() == sum(r.length for r in rows) // 200


def test_odd_trees_are_listed_as_by_spark(spark, tmp_path):
    """Hidden and empty files, links, blanks, globs; a name that is no UTF-8 was passed over before."""
    for name in ("a b/f.txt", "a b/_h/z.txt", ".hid/x.txt", "_k=1/p.md", "x=é/1%20.txt", "_under.txt", "empty.txt", "y._COPYING_"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.txt" else name)
    (tmp_path / "link").symlink_to(tmp_path / "a b")
    (tmp_path / "broken").symlink_to(tmp_path / "none")
    (tmp_path / "loop").symlink_to(tmp_path / "loop")
    for place, glob in ((tmp_path, None), (tmp_path, "*.{md,csv}"), (tmp_path / "a*", None), (tmp_path / "a b" / "f.txt", None), (tmp_path / "empty.txt", None)):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        want = (reader.option("pathGlobFilter", glob) if glob else reader).load(str(place)).select("path", "length", "content")
        assert sorted(tables.read_tree(spark, str(place), glob=glob).collect()) == sorted(want.collect())
    (tmp_path / "only").mkdir()
    with open(bytes(tmp_path / "only") + b"/\xff.txt", "wb") as file:
        file.write(b"odd")
    assert [bytes(r.content) for r in tables.read_tree(spark, str(tmp_path / "only")).collect()] == [b"odd"]


def test_file_statistics_do_not_read_contents(spark, tmp_path):
    """Without the binary check the listing is enough; before, the plan scanned the files themselves, in tasks of 32."""
    small_tree(tmp_path, 3, 5)
    stats = scan.scan_files(spark, str(tmp_path), load_catalogue(["pii"]), skip_binary=False)[1]
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "MapInArrow" not in plan
    for path in tmp_path.rglob("*.txt"):
        path.unlink()
    assert {(r.metric, r.key): r.value for r in stats.collect()} == {
        ("files_total", ""): 15, ("files_scanned", ""): 15, ("files_by_extension", "txt"): 15}


def test_binary_files_are_told_by_their_first_bytes(spark, tmp_path):
    for name, at in (("in.a", 8191), ("out.b", 8192), ("none.c", None)):
        (tmp_path / name).write_bytes(b"x" * 9000 if at is None else b"x" * at + b"\0" + b"x" * 800)
    got = scan.scan_files(spark, str(tmp_path), load_catalogue(["pii"]), size_limit=9000)[1]
    assert {(r.metric, r.key): r.value for r in got.collect()} == {
        ("files_total", ""): 3, ("files_scanned", ""): 2, ("skipped_binary", ""): 1, ("files_by_extension", "b"): 1, ("files_by_extension", "c"): 1}


def test_files_meet_the_patterns_where_they_are_read(spark, tmp_path):
    """Paths are dealt over the tasks, not contents: before, the contents were shuffled."""
    small_tree(tmp_path, 3, 5)
    (tmp_path / ".scanignore").write_text("*/d1/*\n*/a +%20b/*\n")
    (tmp_path / "a +%20b").mkdir()
    (tmp_path / "a +%20b" / "0.txt").write_text("mail e@f.org")
    (tmp_path / "d0" / "e0" / "0.txt").write_text("mail a@b.org")
    (tmp_path / "d1" / "e1" / "0.txt").write_text("mail c@d.org")
    findings, _ = scan.scan_files(spark, str(tmp_path), load_catalogue(["pii"]), skip_binary=False)
    plan = findings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange RoundRobin") == 1 and "MapInArrow" in plan[:plan.index("Exchange RoundRobin")]
    assert [r.matched for r in findings.where("rule = 'email-address'").collect()] == ["a@b.org"]
