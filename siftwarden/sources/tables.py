"""Sources: any table, file trees, key/value settings, diffs, rule bundles."""

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.detect import content_table
from ..schema import RULE_SCHEMA
from ..session import BYTES_A_TASK, shared_folder

__all__ = ["content_table", "read_tree", "kv_from_json", "diff_lines", "diff_files", "read_rules", "read_rule_lists"]


# Entries a task lists before it leaves the directories it did not come to for the next round of tasks.
ENTRIES_A_TASK = 20_000
# Files and bytes of them a task reads, and bytes of one Arrow batch of contents (a file is never split).
FILES_A_TASK = 2_000
BYTES_A_BATCH = 4 * 1024 * 1024


def list_tree(spark, path, glob=None) -> DataFrame:
    """Regular files below ``path``, as ``read_tree`` takes them: a tree is listed once, here.

    On a local (or mounted) file system the tasks list, and (path, length) is written to the checkpoint folder, so the
    driver holds no file; on others Spark's reader lists, which keeps every file on the driver.  Both pass over hidden
    and empty files, as Spark's readers do.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    places = system.globStatus(root) if system.getUri().getScheme() == "file" else None
    if not places:
        # another file system, or nothing there, which the reader tells
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    files = _list_by_tasks(spark, [p.getPath().toUri().getPath() for p in places])
    if glob:
        name = hadoop.GlobPattern(glob).compiled().pattern()
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(rf"(?s)^(?:{name})\z"))
    return files


def _list_by_tasks(spark, roots):
    """(path, length) of the files below local directories, listed by tasks; names are bytes, which need not be UTF-8.

    A task walks the directories it is given until it has seen ``ENTRIES_A_TASK`` entries; those it did not come to are
    dealt over the tasks of another round.
    """
    limit = ENTRIES_A_TASK

    def walk(batches):
        import errno
        import os

        import pyarrow as pa

        rows, seen = [], 0

        def listed():
            return pa.record_batch({"path": pa.array([r[0] for r in rows], pa.binary()), "length": pa.array([r[1] for r in rows], pa.int64())})

        for batch in batches:
            todo = batch.column("path").to_pylist()
            while todo and seen < limit:
                place = todo.pop()
                try:
                    entries = os.scandir(place)
                except NotADirectoryError:
                    rows.append((b"file:" + place, os.stat(place).st_size))
                    continue
                except FileNotFoundError:
                    continue
                with entries:
                    for entry in entries:
                        name, seen = entry.name, seen + 1
                        if name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_"):
                            continue
                        try:
                            if entry.is_dir():
                                todo.append(entry.path)
                            elif entry.is_file():
                                rows.append((b"file:" + entry.path, entry.stat().st_size))
                        except OSError as error:
                            # gone meanwhile, or a link to itself
                            if error.errno not in (errno.ENOENT, errno.ELOOP):
                                raise
                        if len(todo) > limit:
                            rows += [(place, None) for place in todo]
                            todo = []
                        if len(rows) >= 10_000:
                            yield listed()
                            rows = []
            rows += [(place, None) for place in todo]
            if rows:
                yield listed()
                rows = []

    folder, schema = f"{shared_folder(spark)}/{uuid.uuid4()}", "path binary, length bigint"
    todo = spark.createDataFrame([(root.encode(),) for root in roots], "path binary")
    tasks, rounds = len(roots), []
    while tasks:
        rounds.append(f"{folder}/{len(rounds)}")
        most = 8 * spark.sparkContext.defaultParallelism
        todo.repartition(min(tasks, most)).mapInArrow(walk, schema).write.parquet(rounds[-1])
        todo = spark.read.schema(schema).parquet(rounds[-1]).where("length is null").select("path")
        tasks = todo.count()
    files = spark.read.schema(schema).parquet(*rounds).where("length > 0")
    return files.select(F.col("path").cast("string").alias("path"), "length")


def _read_by_tasks(files, head):
    """(path, length, content) of listed local files; with ``head``, only so many of their first bytes.

    Paths are dealt round-robin, not contents, so that a task reads about ``BYTES_A_TASK`` or ``FILES_A_TASK`` files,
    and the number of tasks goes by what is read, not by the number of files.
    """
    read = F.col("length") if head is None else F.least("length", F.lit(head))
    number, size = files.agg(F.count("*"), F.coalesce(F.sum(read), F.lit(0))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(number, max(4 * cores, size // BYTES_A_TASK, number // FILES_A_TASK)))
    most = BYTES_A_BATCH

    def contents(batches):
        import pyarrow as pa

        def read_some(rows):
            columns = zip(*rows)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], ["path", "length", "content"])

        rows, size = [], 0
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with open(path[len(b"file:"):], "rb") as file:
                    content = file.read() if head is None else file.read(head)
                if rows and size + len(content) > most:
                    yield read_some(rows)
                    rows, size = [], 0
                rows.append((path, length, content))
                size += len(content)
        if rows:
            yield read_some(rows)

    dealt = files.select(F.col("path").cast("binary").alias("path"), "length").repartition(tasks)
    return dealt.mapInArrow(contents, "path binary, length bigint, content binary").withColumn("path", F.col("path").cast("string"))


def tree_files(files, size_limit=None, keep=None) -> DataFrame:
    """The files of a listing that are not too large and that ``keep``, a function from a path to a condition, lets through."""
    # Spark's reader skips a file by its metadata only, where the path is a URI
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))) if "content" in files.columns else F.col("path")
    files = files.where(keep(name)) if keep is not None else files
    return files.where(F.col("length") <= size_limit) if size_limit is not None else files


def read_tree(spark, path, size_limit=None, glob=None, keep=None, files=None, head=None) -> DataFrame:
    """Regular files below ``path``: (path, length, content).

    The size limit and ``keep``, a function from a column with the path to a condition, are asked of the listing, so
    the others are never read.  ``files`` is the tree, if it was listed before.  With ``head``, ``content`` has at
    least so many first bytes of a file, where it has them.  Rows come in tasks of bounded size.
    """
    files = tree_files(list_tree(spark, path, glob) if files is None else files, size_limit, keep)
    return files.select("path", "length", "content") if "content" in files.columns else _read_by_tasks(files, head)


# Names of ignore files at the root of a tree; our own, and that of version control.
IGNORE_FILES = (".scanignore", ".gitignore")
IGNORE_FILE_LIMIT = 1 << 20


def read_ignore_files(spark, root, names=IGNORE_FILES):
    """Globs in the ignore files of a root, one list; files that are not there count as empty.

    Spark's readers pass over hidden files, so these few small ones are opened through the file system; one of more
    than a megabyte is refused.
    """
    from ..operators.filters import ignore_globs

    hadoop = spark._jvm.org.apache.hadoop.fs
    globs = []
    for name in names:
        path = hadoop.Path(root, name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            continue
        if system.getFileStatus(path).getLen() > IGNORE_FILE_LIMIT:
            raise ValueError(f"{path.toString()} is larger than {IGNORE_FILE_LIMIT} bytes")
        stream = system.open(path)
        try:
            globs += ignore_globs(bytes(stream.readAllBytes()).decode("utf-8", "replace"))
        finally:
            stream.close()
    return globs


def kv_from_json(df, source, props) -> DataFrame:
    """(source, key, value) rows of a JSON object column."""
    parsed = F.from_json(F.col(props), "map<string,string>")
    return df.select(F.col(source).cast("string").alias("source"), F.explode(parsed).alias("key", "value"))


def _diff_sections():
    """Array of (file, at, body) of a diff: one element per file header, without removed files."""
    heads = "filter(transform(ls, (l, i) -> if(startswith(l, '+++ '), i, null)), i -> i is not null)"
    body = "slice(ls, h + 2, coalesce(get(hs, k + 1), size(ls)) - h - 1)"
    sections = (f"flatten(flatten(transform(array({text.lines('diff')}), ls -> transform(array({heads}), hs -> "
                "transform(hs, (h, k) -> named_struct('file', regexp_replace(substring(ls[h], 5), '^[ab]/', ''), "
                f"'at', h + 1, 'body', {body}))))))")
    return f"filter({sections}, p -> p.file not in ('', '/dev/null'))"


def diff_lines(diffs) -> DataFrame:
    """(diff_id, file, pos, line): lines added to each file, in order.

    ``diffs`` has (diff_id, diff).  A diff is one row, so the file in force at a line is found
    inside the row, section by section, without a window.
    """
    added = "filter(transform(body, (l, i) -> named_struct('pos', at + i, 'line', l)), x -> startswith(x.line, '+'))"
    return diffs.select("diff_id", F.inline(F.expr(_diff_sections()))).select(
        "diff_id", "file", F.inline(F.expr(added))).select(
        "diff_id", "file", "pos", F.expr("substring(line, 2)").alias("line"))


def diff_files(diffs) -> DataFrame:
    """(diff_id, id, text): the added lines of each file of each diff, joined in order.

    A file may have several sections; they meet by row and file, so a diff of many files stays linear.
    """
    added = F.expr("transform(filter(p.body, l -> startswith(l, '+')), l -> substring(l, 2))")
    numbered = diffs.withColumn("row", F.monotonically_increasing_id())
    sections = numbered.select("row", "diff_id", F.posexplode(F.expr(_diff_sections())).alias("pos", "p"))
    sections = sections.select("row", "diff_id", F.col("p.file").alias("id"), F.struct("pos", added.alias("added")).alias("part"))
    whole = sections.groupBy("row", "diff_id", "id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    rows = whole.select("diff_id", "id", F.flatten(F.transform("parts", lambda p: p.added)).alias("added"))
    return rows.where("size(added) > 0").select("diff_id", "id", F.array_join("added", "\n").alias("text"))


def read_diff_lines(spark, path) -> DataFrame:
    """(diff_id, split, at, file, line): the added lines of diff files of any size, read as split text.

    ``diff_id`` is the diff's path; (split, at) orders its lines.  A header is in force until the next one, which may
    lie splits away: inside a split it is filled forward, and the last header of each split is carried over a table of
    one row a split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("diff_id"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("value"))
    header = F.when(F.col("value").startswith("+++ "), F.regexp_replace(F.expr("substring(value, 5)"), "^[ab]/", ""))
    lines = lines.withColumn("header", header)
    last = lines.groupBy("diff_id", "split").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("diff_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("diff_id", "split", F.last("last", ignorenulls=True).over(before).alias("carried"))
    here = Window.partitionBy("diff_id", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("own", F.last("header", ignorenulls=True).over(here)).join(carried, ["diff_id", "split"])
    filled = filled.withColumn("file", F.coalesce("own", "carried"))
    added = "startswith(value, '+') and header is null and file not in ('', '/dev/null')"
    return filled.where(added).select("diff_id", "split", "at", "file", F.expr("substring(value, 2)").alias("line"))


def diff_files_of(lines) -> DataFrame:
    """(diff_id, id, text): the added lines of each file of each diff, joined in order; one file's fit one row."""
    rows = lines.groupBy("diff_id", F.col("file").alias("id")).agg(F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("rows"))
    return rows.select("diff_id", "id", F.array_join(F.transform("rows", lambda r: r.line), "\n").alias("text"))


_PATTERN_FIELDS = ("name string, category string, match string, match_pattern string, enabled boolean, severity string, "
                   "confidence string, min_entropy double, minEntropy double, description string, reference string, "
                   "tags array<string>, env_var boolean, binary boolean")


def _rules_from(df) -> DataFrame:
    """Normalize authored rules to the rule schema; both spellings of the pattern key are read."""
    types = {f.name: f.dataType for f in RULE_SCHEMA.fields}
    return df.select(
        F.col("ordinal").cast("int"), "name", "category",
        F.coalesce("match", "match_pattern").alias("match"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.coalesce("confidence", F.lit("medium")).alias("confidence"),
        F.coalesce("min_entropy", "minEntropy").alias("min_entropy"),
        F.coalesce("description", F.lit("")).alias("description"), "reference",
        F.coalesce("tags", F.array().cast(types["tags"])).alias("tags"),
        F.coalesce("env_var", F.lit(False)).alias("env_var"),
        F.coalesce("binary", F.lit(False)).alias("binary"))


def read_rules(spark, path) -> DataFrame:
    """Rule catalogue from a JSON bundle (gzip or not) or JSON array of rules."""
    raw = spark.read.text(path, wholetext=True)
    bundle = F.from_json("value", f"schema_version int, created_at string, patterns array<struct<{_struct()}>>")
    array = F.from_json("value", f"array<struct<{_struct()}>>")
    picked = F.when(F.trim("value").startswith("["), array).otherwise(bundle["patterns"])
    return _rules_from(raw.select(F.posexplode(picked).alias("ordinal", "r")).select("ordinal", "r.*"))


def bundle_version(spark, path) -> int:
    row = spark.read.text(path, wholetext=True).select(
        F.get_json_object("value", "$.schema_version").cast("int")).first()
    return row[0]


def _struct():
    return re.sub(r"(\w+) ([a-z<>]+)(,|$)", r"\1:\2\3", _PATTERN_FIELDS)


def read_rule_lists(spark, path) -> DataFrame:
    """Rules from YAML lists, one list per file (flat ``key: value`` items).

    Files are taken in the order of their paths and read on the driver, where the catalogue lives, a
    partition at a time; a list whose items nest deeper needs the JSON form.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml").withColumn("path", F.input_file_name())
    lists = sorted((row["path"], _yaml_items(row["value"])) for row in files.toLocalIterator())
    rules = [rule for _, items in lists for rule in items]
    return _rules_from(spark.createDataFrame(
        [(i, *(_typed(k, rule.get(k)) for k in _fields())) for i, rule in enumerate(rules)],
        f"ordinal int, {_PATTERN_FIELDS}"))


def _fields():
    return [f.split()[0] for f in _PATTERN_FIELDS.split(", ")]


def _typed(key, value):
    if value is None or value in ("", "null", "~"):
        return None if key != "tags" else None
    if key in ("enabled", "env_var", "binary"):
        return str(value).lower() == "true"
    if key in ("min_entropy", "minEntropy"):
        return float(value)
    if key == "tags":
        return value if isinstance(value, list) else [v.strip(" '\"") for v in value.strip("[]").split(",") if v.strip()]
    return value


def _unquote(value):
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] == "'":
        return value[1:-1].replace("''", "'")
    if len(value) > 1 and value[0] == value[-1] == '"':
        return re.sub(r'\\(["\\])', r"\1", value[1:-1])
    return value


def _yaml_items(content):
    """Items of a flat YAML list; block lists are read for ``tags``."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        loaded = yaml.safe_load(content)
        return loaded if isinstance(loaded, list) else [loaded]
    items, current, open_key = [], None, None
    for line in content.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        head = re.match(r"^(\s*)(- )?([A-Za-z_]+):(?:\s+(.*))?$", line)
        if head and (head[2] or current is not None or not items):
            if head[2] or current is None:
                current = {}
                items.append(current)
            open_key = head[3] if not head[4] else None
            current[head[3]] = _unquote(head[4]) if head[4] else []
        elif open_key and line.strip().startswith("- "):
            current[open_key].append(_unquote(line.strip()[2:]))
    return items
