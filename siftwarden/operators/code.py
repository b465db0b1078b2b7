"""Source-code analysis over a table of (path, content): lints, complexity, flow, resources.

Each file is one row, and its lines are an array inside the row: nothing here shuffles but ``resource_pairs``,
whose events meet by row.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..session import spread

# Words the lints look for.
DEBUG_OUTPUT = ("console.log", "console.error", "System.out.println", "print(")
LOCAL_HOSTS = ("localhost", "127.0.0.1")
DYNAMIC_CODE = ("eval(", "exec(", "Runtime.getRuntime().exec")
SECRET_WORDS = ("password", "secret", "api_key")
TODO_WORDS = ("TODO", "FIXME", "HACK")

# Substrings whose count makes up the complexity of a language.
BRANCH_WORDS = {
    "go": ("if", "for", "case", "&&", "||"),
    "rust": ("if", "match", "for", "while", "||", "&&"),
}


def any_of(x, words):
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def starts(x, words):
    return "(" + " or ".join(f"startswith({x}, '{w}')" for w in words) + ")"


def _finding(condition, rule, severity, confidence, description):
    return (f"if({condition}, named_struct('rule', '{rule}', 'severity', '{severity}', "
            f"'confidence', '{confidence}', 'description', '{description}'), null)")


COMMON_LINTS = [
    _finding(any_of("t", DEBUG_OUTPUT), "debug-artifact", "low", "high", "debug output left in code"),
    _finding(f"{any_of('t', LOCAL_HOSTS)} and not {starts('t', ('//', '#', '/*'))} and octet_length(t) > 5",
             "hardcoded-host", "low", "medium", "local host name or address in code"),
    _finding(any_of("t", DYNAMIC_CODE), "dangerous-execution", "high", "high", "code run from a string"),
]
GO_LINTS = [
    _finding("contains(l, 'exec.Command') and not startswith(l, '//') and not " + starts("t", ("//", "/*")),
             "command-injection", "high", "medium", "command built at run time"),
    _finding(f"contains(l, ':=') and {any_of('l', SECRET_WORDS)}",
             "hardcoded-credentials", "high", "low", "credential assigned in code"),
]
RUST_COMMENT = starts("t", ("//", "/*", "*/"))
RUST_LINTS = [
    _finding(f"not {RUST_COMMENT} and contains(t, 'unsafe ')", "unsafe-code", "medium", "high", "unsafe block"),
    _finding(f"not {RUST_COMMENT} and {any_of('t', ('.unwrap()', '.expect('))}",
             "panic-possible", "medium", "high", "call that can panic"),
]


def _lint(files, lints, words) -> DataFrame:
    """Findings of kind ``ast``; only files that hold one of ``words`` are split into lines."""
    per_line = (f"flatten(transform({text.lines('text')}, (l, i) -> transform(array({text.trimmed('l')}), t -> "
                f"transform(filter(array({', '.join(lints)}), x -> x is not null), x -> named_struct("
                "'line', i + 1, 'matched', l, 'lint', x)))[0]))")
    found = spread(files.where(any_of("text", words)).select("id", "text")).select("id", F.inline(F.expr(per_line)))
    return found.select("id", F.col("lint.rule").alias("rule"), F.lit("code").alias("category"),
                        F.col("lint.severity").alias("severity"), F.col("lint.confidence").alias("confidence"),
                        F.col("line").cast("int").alias("line"), "matched",
                        F.col("lint.description").alias("description"), F.lit("ast").alias("kind"),
                        F.expr(scalars.fingerprint("lint.rule", "id", "line", "matched")).alias("fingerprint"))


def lint_common(files) -> DataFrame:
    return _lint(files, COMMON_LINTS, DEBUG_OUTPUT + LOCAL_HOSTS + DYNAMIC_CODE)


def lint_go(files) -> DataFrame:
    return _lint(files, GO_LINTS, ("exec.Command", ":="))


def lint_rust(files) -> DataFrame:
    return _lint(files, RUST_LINTS, ("unsafe ", ".unwrap()", ".expect("))


def lint_by_language(files) -> DataFrame:
    """Language lints by the extension of ``id``, and the common ones for every file."""
    tongue = files.withColumn("language", F.expr(scalars.language("id")))
    return (lint_common(files)
            .unionByName(lint_go(tongue.where("language = 'go'")))
            .unionByName(lint_rust(tongue.where("language = 'rust'"))))


def code_complexity(files, language=None) -> DataFrame:
    """Metrics per file; languages without an analysis have default metrics.

    ``language`` is a column expression; by default it comes from the extension of ``id``.
    """
    kept = (f"array_join(filter({text.lines('text')}, l -> not transform(array({text.trimmed('l')}), "
            f"t -> {RUST_COMMENT})[0]), '\\n')")
    body = spread(files.select("id", "text")).select("id", "text", F.expr(language or scalars.language("id")).alias("language")).withColumn(
        "body", F.when(F.col("language") == "rust", F.expr(kept)).otherwise(F.col("text")))
    counted = {tongue: " + ".join(text.occurrences("body", w) for w in words)
               for tongue, words in BRANCH_WORDS.items()}
    # parameters of the widest one-line function head
    arguments = "substring_index(substring(l, instr(l, '(') + 1), ')', 1)"
    width = (f"if(contains(l, 'fn ') and not contains(l, '//') and instr(l, '(') > 0 and "
             f"instr(l, ')') > instr(l, '(') + 1, {text.occurrences(arguments, ',')} + 1, 0)")
    known = "language in ('go', 'rust')"
    return body.select(
        "id", "language",
        F.expr(f"cast(case language when 'go' then {counted['go']} when 'rust' then {counted['rust']} "
               "else 0 end as int)").alias("cyclomatic"),
        F.lit(0).alias("cognitive"),
        F.expr(f"cast(if({known}, {text.line_count('text')}, 0) as int)").alias("loc"),
        F.expr(f"cast(if(language = 'rust', array_max(transform(split(body, '\\n'), l -> {width})), 0) as int)"
               ).alias("param_count"),
        F.lit(0).alias("max_nesting"), F.lit(False).alias("has_early_return"),
        F.expr(f"coalesce({known} and {any_of('body', TODO_WORDS)}, false)").alias("has_todo"))


STATEMENT_KIND = (
    "case when startswith(t, 'if') or startswith(t, 'match') then 'conditional' "
    "when startswith(t, 'for') or startswith(t, 'while') then 'loop' "
    "when startswith(t, 'try') or contains(t, 'try {') then 'try' "
    "when startswith(t, 'return') or startswith(t, '->') then 'return' "
    "when startswith(t, 'panic') or contains(t, 'panic!') then 'unwind' else 'statement' end")


def _statements():
    """Array of (kind, line): one element per line that is neither blank nor a comment."""
    numbered = (f"transform({text.lines('text')}, (l, i) -> transform(array({text.trimmed('l')}), "
                f"t -> named_struct('t', t, 'kind', {STATEMENT_KIND}, 'line', i + 1))[0])")
    kept = f"filter({numbered}, s -> s.t <> '' and not startswith(s.t, '//') and not startswith(s.t, '/*'))"
    return f"transform({kept}, s -> named_struct('kind', s.kind, 'line', s.line))"


def flow_nodes(files) -> DataFrame:
    """(id, node_id, kind, line): entry, statements in order, exit."""
    edge = lambda kind, line: f"array(named_struct('kind', '{kind}', 'line', cast({line} as int)))"
    nodes = f"concat({edge('entry', 1)}, {_statements()}, {edge('exit', text.line_count('text'))})"
    return files.select("id", F.posexplode(F.expr(nodes)).alias("node_id", "n")).select(
        "id", "node_id", F.col("n.kind").alias("kind"), F.col("n.line").alias("line"))


def flow_edges(files) -> DataFrame:
    """(id, src, dst): the chain of nodes; a file without statements has none."""
    count = F.size(F.expr(_statements()))
    return files.select("id", count.alias("n")).where("n > 0").select(
        "id", F.explode(F.expr("sequence(0, n)")).alias("src")).select("id", "src", (F.col("src") + 1).alias("dst"))


def unreachable(files) -> DataFrame:
    """Exit nodes without a predecessor."""
    return files.where(F.size(F.expr(_statements())) == 0).select(
        "id", F.expr(f"cast({text.line_count('text')} as int)").alias("line"))


# Words that acquire and release files, locks and transactions.
OPEN_FILE = ("fopen", "open(", "File::open")
CLOSE_FILE = ("fclose", "close(", "drop(")
OPEN_LOCK = ("Mutex::new", "Lock::new", "pthread_mutex_init")
CLOSE_LOCK = ("unlock(", "pthread_mutex_unlock")
OPEN_WORK = ("BEGIN", "begin()", "db.Begin()")
CLOSE_WORK = ("COMMIT", "ROLLBACK", "commit()", "rollback()")
RESOURCE_WORDS = OPEN_FILE + CLOSE_FILE + OPEN_LOCK + CLOSE_LOCK + OPEN_WORK + CLOSE_WORK


def _events():
    """Array of (op, name, line) in text order; ``op`` is 'open' or 'close'."""
    per_line = []
    for name, opens, closes in (("file", OPEN_FILE, CLOSE_FILE), ("mutex", OPEN_LOCK, CLOSE_LOCK),
                                ("transaction", OPEN_WORK, CLOSE_WORK)):
        per_line.append(
            f"case when {any_of('l', opens)} then named_struct('op', 'open', 'name', '{name}', 'line', i + 1) "
            f"when {any_of('l', closes)} then named_struct('op', 'close', 'name', '{name}', 'line', i + 1) end")
    return (f"filter(flatten(transform({text.lines('text')}, (l, i) -> array({', '.join(per_line)}))), "
            "e -> e is not null)")


def resource_pairs(files) -> DataFrame:
    """(id, name, acquire_line, release_line): one stack per row, even where rows share an id, across kinds.

    A closing word releases whatever is on top of the stack; what stays open has no release line.
    No stack is built: the height of the stack after each event is a running sum that never falls
    below zero, and what opens at a height is released by the next event at that height.
    """
    events = files.where(any_of("text", RESOURCE_WORDS)).withColumn("row", F.monotonically_increasing_id()).select("row", "id", F.posexplode(F.expr(_events())).alias("pos", "e"))
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.select("row", "id", "pos", "e.*").withColumn("opens", F.col("op") == "open").withColumn(
        "sum", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(so_far))
    # closing words that find the stack empty only lower the running minimum
    lowest = F.least(F.lit(0), F.min("sum").over(so_far))
    level = summed.withColumn("lowest", lowest).withColumn(
        "idle", ~F.col("opens") & (F.col("sum") == F.col("lowest")) & (F.coalesce(
            F.lag("lowest").over(Window.partitionBy("row").orderBy("pos")), F.lit(0)) > F.col("lowest")))
    level = level.where("not idle").withColumn("level", F.expr("sum - lowest + if(opens, 0, 1)"))
    after = F.lead("line").over(Window.partitionBy("row", "level").orderBy("pos"))
    return level.withColumn("release_line", after).where("opens").select(
        "id", "name", F.col("line").alias("acquire_line"), "release_line")


def flow_issues(files) -> DataFrame:
    """Findings of kind ``cfg``: open resources and unreachable exits."""
    issue = "case name when 'mutex' then 'lock-not-released' when 'transaction' then 'transaction-not-ended' " \
            "else 'resource-leak' end"
    leaks = resource_pairs(files).where("release_line is null").select(
        "id", F.expr(issue).alias("rule"), F.lit("medium").alias("severity"),
        F.col("acquire_line").alias("line"), F.col("name").alias("matched"),
        F.format_string("%s acquired at line %d may not be released", "name", "acquire_line").alias("description"))
    dead = unreachable(files).select(
        "id", F.lit("unreachable-code").alias("rule"), F.lit("low").alias("severity"), "line",
        F.lit("").alias("matched"), F.format_string("unreachable code at line %d", "line").alias("description"))
    both = leaks.unionByName(dead)
    return both.select("id", "rule", F.lit("code").alias("category"), "severity",
                       F.lit("high").alias("confidence"), "line", "matched", "description",
                       F.lit("cfg").alias("kind"),
                       F.expr(scalars.fingerprint("rule", "id", "line", "matched")).alias("fingerprint"))
