"""DuckDB SQL for the registered queries, generated from the same rule rows.

The SQL is written for checking, not for speed: every rule is tried on every row.
"""

from . import schema
from .plans.patterns import to_re2


def q(value):
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def content(table, key, text):
    return f"SELECT CAST({key} AS VARCHAR) AS id, {text} AS text FROM {table}"


def entropy(x, base=None):
    share = f"((length({x}) - length(replace({x}, ch, '')))::DOUBLE / strlen({x}))"
    log = f"log2({share})" if base is None else f"(ln({share}) / ln({base}))"
    chars = f"list_sort(list_distinct(regexp_extract_all({x}, '(?s).')))"
    return f"(CASE WHEN {x} = '' THEN 0.0 ELSE list_sum(list_transform({chars}, lambda ch: -{share} * {log})) END)"


def case_of(x, table, default):
    return f"(CASE {x} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END)"


def severity_weight(x):
    return case_of(x, schema.SEVERITY_WEIGHTS, schema.UNKNOWN_SEVERITY_WEIGHT)


def severity_rank(x):
    return case_of(x, {"critical": 4, "high": 3, "medium": 2, "low": 1}, 0)


def tenths(x, table, default):
    return case_of(x, {k: round(v * 10) for k, v in table.items()}, round(default * 10))


def hundredths(n="n"):
    confidence = tenths("confidence", schema.CONFIDENCE_FACTORS, schema.UNKNOWN_CONFIDENCE_FACTOR)
    category = tenths("category", schema.CATEGORY_WEIGHTS, schema.UNKNOWN_CATEGORY_WEIGHT)
    return f"({n} * {severity_weight('severity')} * {confidence} * {category})"


def risk_level(x):
    cases = " ".join(f"WHEN {x} < {limit} THEN {q(name)}" for limit, name in schema.RISK_LIMITS)
    return f"(CASE WHEN {x} <= 0 THEN 'none' {cases} ELSE 'critical' END)"


def meta(rules):
    """CTE body with the metadata of the rules."""
    fields = ["ordinal", "name", "category", "severity", "confidence", "min_entropy", "description"]
    rows = ", ".join("(" + ", ".join(q(r[f]) for f in fields) + ")" for r in rules)
    return (f"SELECT o AS ordinal, r AS rule, c AS category, s AS severity, k AS confidence, "
            f"CAST(e AS DOUBLE) AS min_entropy, d AS description FROM (VALUES {rows}) t(o, r, c, s, k, e, d)")


def _branches(rules, columns):
    out = []
    for r in rules:
        pattern = q(to_re2(r["match"]))
        out.append(f"SELECT id, {r['ordinal']} AS ordinal, {columns.format(p=pattern)} FROM c "
                   f"WHERE regexp_matches(text, {pattern})")
    return " UNION ALL ".join(out)


def counts(rules, source, keep=""):
    """CTEs c, meta, hits, graded(id, rule, category, severity, confidence, n)."""
    gated = f"len(list_filter(m, lambda x: {entropy('x')} >= min_entropy))"
    return (f"WITH c AS MATERIALIZED ({source}), meta AS ({meta(rules)}), "
            f"hits AS ({_branches(rules, 'regexp_extract_all(text, {p}) AS m')}), "
            f"graded AS (SELECT * FROM (SELECT id, rule, category, severity, confidence, "
            f"CASE WHEN min_entropy IS NULL THEN len(m) ELSE {gated} END AS n "
            f"FROM hits JOIN meta USING (ordinal)) WHERE n > 0)")


def findings(rules, source, cte="c"):
    """CTEs up to f(id, rule, category, severity, confidence, line, start_byte, end_byte, matched, ...)."""
    total = lambda array, upto, value: f"coalesce(list_sum(list_transform({array}[1:{upto}], lambda x: {value})), 0)"
    newlines = "length(x) - length(replace(x, chr(10), ''))"
    start = f"{total('g', 'i', 'strlen(x)')} + {total('m', 'i - 1', 'strlen(x)')}"
    line = f"1 + {total('g', 'i', newlines)} + {total('m', 'i - 1', newlines)}"
    columns = "regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g"
    return (f"WITH c AS MATERIALIZED ({source}), meta AS ({meta(rules)}), "
            f"hits AS MATERIALIZED ({_branches(rules, columns)}), "
            "numbered AS (SELECT id, ordinal, m, g, unnest(generate_series(1, len(m))) AS i FROM hits), "
            f"placed AS (SELECT id, ordinal, m[i] AS matched, CAST({line} AS INTEGER) AS line, "
            f"CAST({start} AS BIGINT) AS start_byte FROM numbered), "
            "f AS (SELECT id, rule, category, severity, confidence, line, start_byte, "
            "start_byte + strlen(matched) AS end_byte, matched, CAST(length(matched) AS INTEGER) AS matched_len, "
            "description, 'pattern' AS kind, rule || ':' || id || ':' || line || ':' || matched AS fingerprint, ordinal "
            "FROM placed JOIN meta USING (ordinal) "
            f"WHERE min_entropy IS NULL OR {entropy('matched')} >= min_entropy)")


def lines(x):
    """Lines as a list: both line ends count, a last empty line does not."""
    parts = f"string_split_regex({x}, '\\r?\\n')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def line_count(x):
    return (f"(length({x}) - length(replace({x}, chr(10), '')) + "
            f"CASE WHEN {x} = '' OR suffix({x}, chr(10)) THEN 0 ELSE 1 END)")


def occurrences(x, part):
    return f"((length({x}) - length(replace({x}, {q(part)}, ''))) // {len(part)})"


def risk_rows(keys="id"):
    """SELECT of id, score, level, finding_count, highest_severity over graded rows ``g0``."""
    return (f"SELECT {keys}, score, {risk_level('score')} AS level, finding_count, highest_severity FROM ("
            f"SELECT {keys}, CAST(sum(units // 100) AS INTEGER) AS score, CAST(sum(n) AS BIGINT) AS finding_count, "
            f"max(struct_pack(w := w, s := severity)).s AS highest_severity FROM ("
            f"SELECT {keys}, category, sum({hundredths()}) AS units, sum(n) AS n, "
            f"max(struct_pack(w := {severity_weight('severity')}, s := severity)).w AS w, "
            f"max(struct_pack(w := {severity_weight('severity')}, s := severity)).s AS severity "
            f"FROM g0 GROUP BY {keys}, category) GROUP BY {keys})")


def breakdown(key=None):
    """SELECT of by_category and by_severity, as text, over graded rows ``g0``, for each key."""
    keys, group = (f"{key}, ", f"{key}, ") if key else ("", "")
    using = f"a LEFT JOIN s USING ({key})" if key else "a CROSS JOIN s"
    by = f" GROUP BY {key}" if key else ""
    return (f"WITH a AS (SELECT {keys}string_agg(category || '=' || u || '/' || n, ',' ORDER BY category) AS by_category FROM ("
            f"SELECT {keys}category, CAST(sum({hundredths()}) AS BIGINT) AS u, CAST(sum(n) AS BIGINT) AS n FROM g0 GROUP BY {group}category){by}), "
            f"s AS (SELECT {keys}string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity FROM ("
            f"SELECT {keys}severity, CAST(sum(n) AS BIGINT) AS n FROM g0 GROUP BY {group}severity){by}) "
            f"SELECT {keys}by_category, by_severity FROM {using}")
