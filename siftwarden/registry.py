"""Queries over the given tables, one per operator, with the SQL that checks them.

``QUERIES[name]`` takes (spark, folder); ``SQL[name]`` is the DuckDB twin.  Every query runs over
whole tables and whole texts.
"""

import re
import uuid

from pyspark.sql import functions as F

from . import oracle as O
from .functions import scalars
from .operators import catalog, clones, code, filters, risk, suppress
from .operators.detect import (active_rules, build_index, capture_groups, category_hits, content_table, detect,
                               match_counts, match_spans)
from .plans import profiles, scan
from .plans.patterns import to_re2
from .rules import load_catalogue
from .schema import LANGUAGES
from .session import shared_folder, spread
from .sources import sinks, tables
from .streaming import streams

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


# --- rule sets -------------------------------------------------------------------------------
ALL = active_rules(load_catalogue())
PII = active_rules(load_catalogue(["pii"]))
TEXT = active_rules(load_catalogue(
    ["secrets", "pii", "compliance", "security_hardening", "ai_safety", "llm_guardrails", "healthcare", "finance"]))
PAGE = active_rules(load_catalogue(["web_security", "ai_detection", "accessibility", "web_development", "pwa"]))
CHAT = active_rules(load_catalogue(["ai_safety", "llm_guardrails", "pii", "secrets"]))


# --- tables ----------------------------------------------------------------------------------
def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf, *keep):
    return content_table(table(spark, sf, "documents"), "doc_id", "text", *keep)


def pages(spark, sf):
    return content_table(table(spark, sf, "pages"), "page_id", "html")


def conversations(spark, sf):
    d = table(spark, sf, "conversations")
    return content_table(d.withColumn("k", F.concat_ws("/", "conv_id", "turn")), "k", "text")


DOCS = O.content("documents", "doc_id", "text")
PAGES = O.content("pages", "page_id", "html")
CHATS = "SELECT conv_id || '/' || turn AS id, text FROM conversations"
FINDING = ["id", "rule", "category", "severity", "confidence", "line", "start_byte", "end_byte", "matched",
           "matched_len", "description", "kind", "fingerprint"]
F_LIST = ", ".join(FINDING)


def counted(content, rules):
    index = build_index(rules)
    return risk.graded_counts(match_counts(content, index), index)


# --- detection -------------------------------------------------------------------------------
@query("detect", f"{O.findings(TEXT, DOCS)} SELECT {F_LIST} FROM f")
def _(spark, sf):
    return detect(documents(spark, sf), TEXT).select(FINDING)


@query("detect_pages", f"{O.findings(PAGE, PAGES)} SELECT {F_LIST} FROM f")
def _(spark, sf):
    return detect(pages(spark, sf), PAGE).select(FINDING)


@query("detect_conversations", f"{O.findings(CHAT, CHATS)} SELECT {F_LIST} FROM f")
def _(spark, sf):
    return detect(conversations(spark, sf), CHAT).select(FINDING)


for _name, _read, _source in (("rule_hits", documents, DOCS), ("rule_hits_pages", pages, PAGES),
                              ("rule_hits_conversations", conversations, CHATS)):
    @query(_name, f"{O.counts(ALL, _source)} SELECT rule, count(DISTINCT id) AS rows, "
                  "CAST(sum(n) AS BIGINT) AS matches FROM graded GROUP BY rule")
    def _(spark, sf, read=_read):
        index = build_index(ALL)
        return risk.rule_hits(match_counts(read(spark, sf), index), index)


def _category_sql(rules, source):
    return (f"WITH c AS MATERIALIZED ({source}), meta AS ({O.meta(rules)}), hits AS ({O._branches(rules, '1 AS one')}) "
            "SELECT DISTINCT id, category FROM hits JOIN meta USING (ordinal)")


@query("category_prefilter", _category_sql(TEXT, DOCS))
def _(spark, sf):
    return category_hits(documents(spark, sf), TEXT)


@query("match_attribution", f"{O.findings(PII, DOCS)}, peers AS (SELECT * FROM (VALUES "
       + ", ".join(f"({r['ordinal']}, {O.q(r['name'])}, {O.q(to_re2(r['match']))})" for r in PII)
       + ") p(po, pname, pattern)), distinct_texts AS (SELECT DISTINCT matched FROM f), owner AS ("
       "SELECT matched, min(po) AS po FROM distinct_texts JOIN peers ON regexp_matches(matched, pattern) GROUP BY matched) "
       "SELECT id, line, start_byte, f.matched, coalesce(pname, rule) AS rule FROM f "
       "LEFT JOIN owner ON f.matched = owner.matched LEFT JOIN peers ON owner.po = peers.po")
def _(spark, sf):
    found = detect(documents(spark, sf), PII, attribution="first")
    return found.select("id", "line", "start_byte", "matched", "rule")


@query("line_numbers", f"{O.findings(PII, DOCS)} SELECT rule, line, count(*) AS findings FROM f GROUP BY rule, line")
def _(spark, sf):
    return detect(documents(spark, sf), PII).groupBy("rule", "line").agg(F.count("*").alias("findings"))


@query("match_offsets", f"{O.findings(PII, PAGES)} SELECT id, ordinal, start_byte, end_byte FROM f")
def _(spark, sf):
    return match_spans(pages(spark, sf), PII).select("id", "ordinal", "start_byte", "end_byte")


_GROUPED = next(r for r in PII if r["name"] == "phone-number")


@query("capture_groups", f"WITH c AS ({DOCS}), m AS (SELECT id, "
       + ", ".join(f"regexp_extract_all(text, {O.q(_GROUPED['match'])}, {k}) AS g{k}" for k in (0, 1))
       + " FROM c), n AS (SELECT *, unnest(generate_series(1, len(g0))) AS i FROM m) "
       "SELECT id, CAST(i - 1 AS INTEGER) AS match_index, g0[i] AS matched, nullif(g1[i], '') AS group1 FROM n")
def _(spark, sf):
    rows = capture_groups(documents(spark, sf), _GROUPED, 1)
    return rows.select("id", "match_index", "matched", F.col("groups")[0].alias("group1"))


def _groups_sql(rules):
    parts = []
    for r in rules:
        n = re.compile(r["match"]).groups
        columns = ", ".join(f"regexp_extract_all(text, {O.q(to_re2(r['match']))}, {k}) AS g{k}" for k in range(n + 1))
        own = ", ".join(f"coalesce(g{k}[i], '')" for k in range(1, n + 1))
        parts.append(f"SELECT id, {O.q(r['name'])} AS rule, CAST(i - 1 AS INTEGER) AS match_index, g0[i] AS matched, "
                     f"CAST(array_to_string([{own}], '|') AS VARCHAR) AS groups, min_entropy FROM (SELECT *, unnest(generate_series(1, len(g0))) AS i "
                     f"FROM (SELECT id, CAST({O.q(r['min_entropy'])} AS DOUBLE) AS min_entropy, {columns} FROM c))")
    return f"WITH c AS ({DOCS}) SELECT id, rule, matched, groups FROM (" + " UNION ALL ".join(parts) + (
        f") WHERE min_entropy IS NULL OR {O.entropy('matched')} >= min_entropy")


# RE2 does not tell an unset group from an empty one
@query("capture_groups_all", _groups_sql(PII))
def _(spark, sf):
    found = detect(documents(spark, sf), PII, groups=True)
    return found.select("id", "rule", "matched", F.array_join(F.transform("groups", lambda g: F.coalesce(g, F.lit(""))), "|").alias("groups"))


GATED = [{**r, "min_entropy": 2.5} for r in PII]


@query("entropy_gate", f"{O.counts(GATED, DOCS)} SELECT id, rule, CAST(n AS BIGINT) AS n FROM graded")
def _(spark, sf):
    return counted(documents(spark, sf), GATED).select("id", "rule", "n")


# --- diffs, settings, requests, files ----------------------------------------------------------
DIFF = ("'--- a/doc' || chr(10) || '+++ b/' || source || '/' || lang || '/' || doc_id || chr(10) || '+' || "
        "replace(text, chr(10), chr(10) || '+') || chr(10) || ' unchanged' || chr(10) || '-removed 4111111111111111' "
        "|| chr(10) || '+++ /dev/null' || chr(10) || '+dropped 4111111111111111'")
DIFF_C = ("SELECT source || '/' || lang || '/' || doc_id AS id, array_to_string(" + O.lines("text")
          + ", chr(10)) AS text FROM documents")


def diffs(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("diff_id"), F.expr(DIFF.replace("chr(10)", "'\\n'")).alias("diff"))


@query("diff_source", f"WITH c AS ({DIFF_C}) SELECT id AS file, text FROM c")
def _(spark, sf):
    return tables.diff_files(diffs(spark, sf)).select(F.col("id").alias("file"), "text")


@query("detect_diff", f"{O.findings(PII, DIFF_C)} SELECT id, rule, line, start_byte, matched FROM f")
def _(spark, sf):
    return scan.scan_diff(diffs(spark, sf), PII).select("id", "rule", "line", "start_byte", "matched")


@query("detect_diff_files", f"{O.findings(PII, DIFF_C)} SELECT id, rule, line, start_byte, matched FROM f")
def _(spark, sf):
    """All documents as the files of diffs, one a task, which are read as lines."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    spread(diffs(spark, sf)).select("diff").write.text(path)
    return scan.scan_diff_files(spark, path, PII).select("id", "rule", "line", "start_byte", "matched")


@query("kv_source", "SELECT CAST(event_id AS VARCHAR) AS source, k AS key, json_extract_string(props, '$.\"' || k || '\"') "
       "AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def _(spark, sf):
    return tables.kv_from_json(table(spark, sf, "events"), "event_id", "props")


SETTINGS = [{**r, "env_var": True} for r in PII] + [r for r in load_catalogue(["secrets", "finance"])
                                                  if r["env_var"] or r["category"] == "secrets"]
SETTINGS = [{**r, "min_entropy": 4.0 if r["name"] == "email-address" else r["min_entropy"]} for r in SETTINGS]


@query("detect_kv", f"WITH c AS ({DOCS}), meta AS ({O.meta(SETTINGS)}), hits AS ({O._branches(SETTINGS, 'text')}) "
       f"SELECT id, 'text' AS key, rule, severity, 'text=' || text AS content FROM hits JOIN meta USING (ordinal) "
       f"WHERE min_entropy IS NULL OR {O.entropy('text')} >= min_entropy")
def _(spark, sf):
    settings = documents(spark, sf).select(F.col("id").alias("source"), F.lit("text").alias("key"),
                                           F.col("text").alias("value"))
    return scan.scan_kv(settings, SETTINGS).select("id", "key", "rule", "severity", "content")


@query("detect_batch", f"{O.counts(CHAT, CHATS)}, g0 AS (SELECT id, category, severity, confidence, n FROM graded), "
       f"r AS ({O.risk_rows()}) SELECT c.id, coalesce(score, 0) AS score, coalesce(level, 'none') AS level, "
       "coalesce(finding_count, 0) AS finding_count, highest_severity FROM (SELECT DISTINCT id FROM c) c LEFT JOIN r ON c.id = r.id")
def _(spark, sf):
    return scan.scan_requests(conversations(spark, sf), CHAT).drop("by_category", "by_severity")


@query("content_table_source", f"{DOCS} UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL {CHATS} "
       "UNION ALL SELECT 'e' || event_id, props FROM events")
def _(spark, sf):
    page = content_table(table(spark, sf, "pages").withColumn("k", F.concat(F.lit("p"), "page_id")), "k", "html")
    event = content_table(table(spark, sf, "events").withColumn("k", F.concat(F.lit("e"), "event_id")), "k", "props")
    return documents(spark, sf).unionByName(page).unionByName(conversations(spark, sf)).unionByName(event)


# --- suppression, baseline ---------------------------------------------------------------------
# every text gets a directive of one form, by its language
_MARKED = ("CASE lang WHEN 'en' THEN replace(text, chr(10), ' // scan:ignore:international-phone' || chr(10)) "
           "WHEN 'fr' THEN '# scan:ignore:international-phone' || chr(10) || text "
           "WHEN 'de' THEN replace(text, chr(10), ' # scan:ignore' || chr(10)) "
           "ELSE replace(text, chr(10), chr(10) || '/* scan:ignore:phone-number */' || chr(10)) END")
MARKED = O.content("documents", "doc_id", f"({_MARKED})")
_DIRECTIVE = (r"^(.*?)(?://|#|(/\*)) scan:ignore[ \t]*(?::[ \t]*([^ \t*]+))?[ \t]*(\*/)?[ \t]*$")
_DIRECTIVES = ("d AS (SELECT id, line, CASE WHEN r = '' THEN '*' ELSE r END AS rule, at_start FROM (SELECT id, "
               f"CAST(i AS INTEGER) AS line, regexp_extract(l, {O.q(_DIRECTIVE)}, 3) AS r, "
               f"regexp_extract(l, {O.q(_DIRECTIVE)}, 2) AS o, regexp_extract(l, {O.q(_DIRECTIVE)}, 4) AS e, "
               f"trim(replace(regexp_extract(l, {O.q(_DIRECTIVE)}, 1), chr(9), ' ')) = '' AS at_start FROM ("
               f"SELECT id, ls[i] AS l, i FROM (SELECT id, ls, unnest(generate_series(1, len(ls))) AS i FROM ("
               f"SELECT id, {O.lines('text')} AS ls FROM c))) WHERE regexp_matches(l, {O.q(_DIRECTIVE)})) "
               "WHERE o = '' OR e <> '')")


def marked(spark, sf):
    return content_table(table(spark, sf, "documents").withColumn(
        "text", F.expr(_MARKED.replace("chr(10)", "'\\n'"))), "doc_id", "text")


@query("suppression_list", f"WITH c AS ({MARKED}), {_DIRECTIVES} SELECT rule, count(*) AS directives, "
       "count(DISTINCT id) AS sources FROM d GROUP BY rule")
def _(spark, sf):
    return suppress.suppression_list(marked(spark, sf))


_SCOPES = {
    "same_line": "d.line = f.line AND d.at_start AND d.rule = f.rule",
    "trailing": "d.line = f.line AND d.rule IN (f.rule, '*')",
    "next_line": "d.line + 1 = f.line AND d.at_start AND d.rule IN (f.rule, '*')",
}
for _scope, _condition in _SCOPES.items():
    @query("suppress_inline" if _scope == "trailing" else f"suppress_inline_{_scope}",
           f"{O.findings(PII, MARKED)}, {_DIRECTIVES} SELECT id, rule, line, start_byte, matched FROM f "
           f"WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = f.id AND {_condition})")
    def _(spark, sf, scope=_scope):
        content = marked(spark, sf)
        kept = suppress.suppress_inline(detect(content, PII), content, scope)
        return kept.select("id", "rule", "line", "start_byte", "matched")


# the known findings are those of the French and German documents
_KNOWN = O.content("documents WHERE lang IN ('fr', 'de')", "doc_id", "text")


def known(spark, sf):
    docs = table(spark, sf, "documents").where("lang in ('fr', 'de')")
    return suppress.create_baseline(detect(content_table(docs, "doc_id", "text"), PII))


@query("baseline_create", f"{O.findings(PII, _KNOWN)} SELECT DISTINCT fingerprint FROM f")
def _(spark, sf):
    return known(spark, sf)


@query("suppress_baseline", f"{O.findings(PII, DOCS)} SELECT id, rule, line, matched, fingerprint FROM f "
       "WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang IN ('fr', 'de'))")
def _(spark, sf):
    kept = suppress.suppress_baseline(detect(documents(spark, sf), PII), known(spark, sf))
    return kept.select("id", "rule", "line", "matched", "fingerprint")


@query("baseline_diff", f"{O.findings(PII, DOCS)} SELECT DISTINCT fingerprint, CASE WHEN lang = 'en' THEN 'new' "
       "WHEN lang = 'es' THEN 'resolved' ELSE 'unchanged' END AS status "
       "FROM f JOIN documents ON f.id = CAST(doc_id AS VARCHAR)")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    now = detect(content_table(docs.where("lang <> 'es'"), "doc_id", "text"), PII)
    then = detect(content_table(docs.where("lang <> 'en'"), "doc_id", "text"), PII)
    return suppress.baseline_diff(now, then)


@query("fingerprint", f"{O.findings(PII, DOCS)} SELECT fingerprint, sha256(fingerprint) AS digest FROM f")
def _(spark, sf):
    return detect(documents(spark, sf), PII).select("fingerprint", F.sha2("fingerprint", 256).alias("digest"))


@query("findings_dedup", f"{O.findings(PII, DOCS)} SELECT fingerprint, min(start_byte) AS start_byte FROM f GROUP BY fingerprint")
def _(spark, sf):
    return suppress.dedup(detect(documents(spark, sf), PII)).select("fingerprint", "start_byte")


# --- risk and statistics -----------------------------------------------------------------------
def broken_down(rows):
    """The breakdowns as text: category=hundredths/findings and severity=findings, in order of their names."""
    by_category = F.transform(F.array_sort(F.map_entries("by_category")), lambda e: F.concat(
        e.key, F.lit("="), F.round(e.value.score * 100).cast("bigint").cast("string"), F.lit("/"), e.value.n.cast("string")))
    by_severity = F.transform(F.array_sort(F.map_entries("by_severity")), lambda e: F.concat(
        e.key, F.lit("="), e.value.cast("string")))
    return rows.withColumns({"by_category": F.array_join(by_category, ","), "by_severity": F.array_join(by_severity, ",")})


_TEXT_GRADED = f"{O.counts(TEXT, DOCS)}, g0 AS (SELECT id, category, severity, confidence, n FROM graded)"


@query("risk_score", f"{_TEXT_GRADED}, z AS (SELECT 1 AS one, category, severity, confidence, n FROM g0) "
       + f"SELECT score, level, finding_count, highest_severity, by_category, by_severity FROM ("
       + O.risk_rows("one").replace("FROM g0", "FROM z") + ") CROSS JOIN (" + O.breakdown() + ")")
def _(spark, sf):
    return broken_down(risk.risk_score(counted(documents(spark, sf), TEXT)))


@query("risk_by_source", f"{_TEXT_GRADED}, r AS ({O.risk_rows()}) SELECT c.id, coalesce(score, 0) AS score, "
       "coalesce(level, 'none') AS level, coalesce(finding_count, 0) AS finding_count, highest_severity, "
       "coalesce(by_category, '') AS by_category, coalesce(by_severity, '') AS by_severity "
       f"FROM c LEFT JOIN r ON c.id = r.id LEFT JOIN ({O.breakdown('id')}) b ON c.id = b.id")
def _(spark, sf):
    content = documents(spark, sf)
    return broken_down(risk.risk_by_source(counted(content, TEXT), content))


@query("top_risk_sources", f"{O.counts(PII, DOCS)}, g0 AS (SELECT * FROM graded) "
       f"SELECT * FROM ({O.risk_rows()}) ORDER BY score DESC, id LIMIT 20")
def top_risk(spark, sf):
    return risk.top_risk_sources(risk.risk_by_source(counted(documents(spark, sf), PII)).drop("by_category", "by_severity"), 20)


@query("risk_by_category", f"{_TEXT_GRADED} SELECT category, round(sum({O.hundredths()}) / 100.0, 6) AS score, "
       "CAST(sum(n) AS BIGINT) AS finding_count FROM g0 GROUP BY category")
def _(spark, sf):
    return risk.risk_by_category(counted(documents(spark, sf), TEXT)).withColumn("score", F.round("score", 6))


@query("findings_by_severity", f"{_TEXT_GRADED} SELECT category, severity, CAST(sum(n) AS BIGINT) AS findings "
       "FROM g0 GROUP BY CUBE (category, severity)")
def _(spark, sf):
    return risk.severity_cube(counted(documents(spark, sf), TEXT))


@query("highest_severity", f"{_TEXT_GRADED} SELECT id, max(struct_pack(w := {O.severity_weight('severity')}, "
       "s := severity)).s AS highest_severity FROM g0 GROUP BY id")
def _(spark, sf):
    return risk.highest_severity(counted(documents(spark, sf), TEXT), "id")


_SW = {"critical": 100, "high": 9}
_CW = {"pii": 2.25, "llm-guardrails": 0.4}


@query("risk_custom_weights", f"{_TEXT_GRADED}, u AS (SELECT id, category, sum(n * {O.case_of('severity', _SW, 1)} * "
       + O.tenths("confidence", {"high": 1, "medium": .7, "low": .4}, .5)
       + " * CAST(" + O.case_of("category", {k: f"{v}" for k, v in _CW.items()}, "1.0") + " AS DECIMAL(12,4)) * 10) AS units "
       "FROM g0 GROUP BY id, category) SELECT id, CAST(sum(floor(units / 100)) AS INTEGER) AS score FROM u GROUP BY id")
def _(spark, sf):
    rows = counted(documents(spark, sf), TEXT)
    return risk.risk_by_source(rows, None, _SW, _CW).select("id", "score")


_STATS = ("SELECT 'findings' AS metric, '' AS key, CAST(sum(n) AS BIGINT) AS value FROM g0 UNION ALL "
          "SELECT 'findings_by_severity', severity, CAST(sum(n) AS BIGINT) FROM g0 GROUP BY severity UNION ALL "
          "SELECT 'findings_by_category', category, CAST(sum(n) AS BIGINT) FROM g0 GROUP BY category UNION ALL "
          "SELECT 'rows_total', '', count(*) FROM c UNION ALL "
          "SELECT 'rows_scanned', '', count(*) FROM c WHERE {ok} UNION ALL "
          "SELECT 'rows_skipped', '', count(*) FROM c WHERE NOT ({ok}) UNION ALL "
          "SELECT 'bytes_scanned', '', CAST(sum(strlen(text)) AS BIGINT) FROM c WHERE {ok}").format(
              ok="strlen(text) <= 10485760 AND NOT contains(text[1:8192], chr(0))")


@query("scan_stats", f"{_TEXT_GRADED} {_STATS}")
def _(spark, sf):
    return scan.run_scan(documents(spark, sf), TEXT, f"{shared_folder(spark)}/{uuid.uuid4()}")[1]


@query("scan_runs", f"{O.counts(PII, DOCS)} SELECT name, count(*) AS runs, CAST(sum(files) AS BIGINT) AS files, "
       "CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(findings) AS BIGINT) AS findings, TRUE AS rated FROM ("
       "SELECT unnest(['first', 'again', 'again']) AS name, (SELECT count(*) FROM c) AS files, "
       "(SELECT sum(strlen(text)) FROM c) AS bytes, (SELECT sum(n) FROM graded) AS findings) GROUP BY name")
def _(spark, sf):
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    for name in ("first", "again", "again"):
        scan.run_scan(documents(spark, sf), PII, folder, name)
    runs = scan.read_runs(spark, folder)
    totals = runs.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "findings")])
    rated = risk.throughput(runs).withColumn("rated", (F.col("files_per_second") > 0) & (F.col("mb_per_second") > 0))
    return totals.join(rated.select("name", "runs", "rated"), "name").select("name", "runs", "files", "bytes", "findings", "rated")


@query("stats_merge", f"{O.counts(TEXT, DOCS + ' UNION ALL ' + CHATS)}, g0 AS (SELECT * FROM graded) {_STATS}")
def _(spark, sf):
    index = build_index(TEXT)
    parts = [risk.scan_stats(c, match_counts(c, index), index) for c in (documents(spark, sf), conversations(spark, sf))]
    return risk.stats_merge(*parts)


# each event stands for one scan run
@query("throughput", "SELECT event_type AS name, count(*) AS runs, round(avg(d), 6) AS avg_duration_ms, "
       "round(avg(CASE WHEN d > 0 THEN 1000.0 * user_id / d ELSE 0 END), 6) AS files_per_second, "
       "round(avg(CASE WHEN d > 0 THEN strlen(props) * 1000 / 1048576.0 / d ELSE 0 END), 6) AS mb_per_second, "
       "CAST(sum(1) AS BIGINT) AS findings FROM (SELECT *, CAST(floor(value) AS BIGINT) AS d FROM events) GROUP BY event_type")
def _(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.floor("value").alias("duration_ms"), F.col("user_id").alias("files"),
        (F.octet_length("props") * 1000).cast("bigint").alias("bytes_k"), F.lit(1).cast("bigint").alias("findings"))
    rated = risk.throughput(runs.withColumn("bytes", F.col("bytes_k") / 1000))
    return rated.withColumns({c: F.round(c, 6) for c in ("avg_duration_ms", "files_per_second", "mb_per_second")})


@query("finding_density", f"{_TEXT_GRADED}, l AS (SELECT id, {O.line_count('text')} AS lines FROM c), "
       "t AS (SELECT id, sum(n) AS n FROM g0 GROUP BY id), x AS (SELECT l.id, CAST(lines AS BIGINT) AS lines, "
       "CAST(coalesce(n, 0) AS BIGINT) AS findings, CASE WHEN lines > 0 THEN coalesce(n, 0) * 1000.0 / lines ELSE 0 END AS d "
       "FROM l LEFT JOIN t ON l.id = t.id) SELECT id, lines, findings, round(d, 6) AS density, "
       "CASE WHEN d >= 10 THEN 'high' WHEN d >= 5 THEN 'elevated' WHEN d >= 2 THEN 'moderate' ELSE 'low' END AS band FROM x")
def _(spark, sf):
    content = documents(spark, sf)
    return risk.finding_density(counted(content, TEXT), content).withColumn("density", F.round("density", 6))


@query("rank_findings", f"{O.findings(PII, DOCS)} SELECT id, rule, start_byte, end_byte, row_number() OVER (PARTITION BY id "
       f"ORDER BY {O.severity_weight('severity')} DESC, start_byte, end_byte, rule) AS position FROM f")
def _(spark, sf):
    return risk.rank_findings(detect(documents(spark, sf), PII)).select("id", "rule", "start_byte", "end_byte", "position")


_KINDS = risk.KIND_OF_CATEGORY


@query("risk_action", f"{_TEXT_GRADED}, s AS (SELECT id, category, sum({O.hundredths()}) / 100.0 AS score FROM g0 "
       f"GROUP BY id, category), k AS (SELECT id, category, {O.risk_level('floor(score)')} AS level, "
       f"{O.case_of('category', {c: O.q(k) for c, k in _KINDS.items()}, O.q('informational'))} AS kind FROM s) "
       "SELECT id, category, level, kind, CASE WHEN level = 'none' THEN 'none' WHEN level = 'critical' THEN 'block' "
       "WHEN level = 'low' THEN CASE WHEN kind = 'secrets' THEN 'review' ELSE 'none' END "
       "WHEN level = 'medium' THEN CASE WHEN kind IN ('secrets', 'security') THEN 'fix' WHEN kind = 'compliance' "
       "THEN 'compliance_review' ELSE 'review' END WHEN kind IN ('secrets', 'security') THEN 'block' "
       "WHEN kind = 'compliance' THEN 'compliance_review' ELSE 'fix' END AS action, "
       "CASE level WHEN 'none' THEN 5 WHEN 'low' THEN 4 WHEN 'medium' THEN 3 WHEN 'high' THEN 2 ELSE 1 END AS priority FROM k")
def _(spark, sf):
    per = risk.risk_by_source_category(counted(documents(spark, sf), TEXT))
    return risk.risk_action(per).select("id", "category", "level", "kind", "action", "priority")


# --- exports -----------------------------------------------------------------------------------
@query("findings_json", f"{O.findings(PII, DOCS)} SELECT id, to_json(struct_pack(id := id, rule := rule, line := line, "
       "start_byte := start_byte, severity := severity, fingerprint := fingerprint)) AS json FROM f")
def _(spark, sf):
    rows = detect(documents(spark, sf), PII).select("id", "rule", "line", "start_byte", "severity", "fingerprint")
    return sinks.findings_json(rows)


_LEVEL = ("CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' "
          "WHEN severity = 'low' THEN 'note' ELSE 'none' END")


@query("findings_documents", f"{O.findings(PII, DOCS)}, n AS (SELECT id, CAST(to_json(map_from_entries(list(struct_pack(k := severity, v := n) "
       "ORDER BY severity))) AS VARCHAR) AS by_severity FROM (SELECT id, severity, count(*) AS n FROM f GROUP BY id, severity) GROUP BY id), "
       "k AS (SELECT id, CAST(to_json(map_from_entries(list(struct_pack(k := category, v := n) ORDER BY category))) AS VARCHAR) AS by_category "
       "FROM (SELECT id, category, count(*) AS n FROM f GROUP BY id, category) GROUP BY id), "
       f"t AS (VALUES {', '.join('(' + str(r['ordinal']) + ', ' + '[' + ', '.join(O.q(x) for x in r['tags']) + '])' for r in PII)}), "
       "r AS (SELECT f.id, start_byte, end_byte, rule, CAST(to_json(struct_pack(id := f.id, rule := rule, category := category, severity := severity, "
       "confidence := confidence, line := line, start_byte := start_byte, end_byte := end_byte, matched := matched, matched_len := matched_len, "
       "description := description, tags := t.col1, kind := kind, fingerprint := fingerprint)) AS VARCHAR) AS j "
       "FROM f JOIN t ON f.ordinal = t.col0), "
       "x AS (SELECT id, string_agg(j, ',' ORDER BY start_byte, end_byte, rule) AS js, count(*) AS n FROM r GROUP BY id) "
       "SELECT x.id, 0 AS part, '{\"findings\":[' || js || '],\"stats\":{\"findings\":' || n || ',\"by_severity\":' || by_severity || "
       "',\"by_category\":' || by_category || '}}' AS document FROM x JOIN n ON x.id = n.id JOIN k ON x.id = k.id")
def _(spark, sf):
    return sinks.findings_documents(detect(documents(spark, sf), PII))


@query("findings_sink_runs", f"{O.findings(PII, DOCS)} SELECT run, id, rule, category, line, start_byte FROM f, "
       "(SELECT unnest(['a', 'b']) AS run) WHERE run = 'a' OR severity = 'high'")
def _(spark, sf):
    """Two runs, the second written twice: first with all findings, then with the severe ones only."""
    path, found = f"{shared_folder(spark)}/{uuid.uuid4()}", detect(documents(spark, sf), PII)
    for run, rows in (("a", found), ("b", found), ("b", found.where("severity = 'high'"))):
        sinks.write_findings(rows, path, run=run)
    return spark.read.parquet(path).select("run", "id", "rule", "category", "line", "start_byte")


@query("findings_sarif", f"{O.findings(PII, DOCS)} SELECT id, fingerprint, CAST(json_object('ruleId', rule, 'level', {_LEVEL}, "
       "'message', json_object('text', description), 'locations', json_array(json_object('physicalLocation', "
       "json_object('artifactLocation', json_object('uri', id), 'region', json_object('startLine', line, "
       "'startColumn', start_byte + 1))))) AS VARCHAR) AS result FROM f")
def _(spark, sf):
    rows = sinks.sarif_results(detect(documents(spark, sf), PII))
    return rows.select("id", "fingerprint", F.to_json("result").alias("result"))


@query("findings_sink", f"{O.findings(PII, DOCS)} SELECT id, rule, category, line, start_byte, fingerprint FROM f")
def _(spark, sf):
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    sinks.write_findings(detect(documents(spark, sf), PII), path)
    return spark.read.parquet(path).select("id", "rule", "category", "line", "start_byte", "fingerprint")


def document_files(spark, sf):
    """Folder with one file per document; a file ends in a line break."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    sinks.write_tree(table(spark, sf, "documents"), path)
    return path


@query("file_tree_source", "SELECT CAST(strlen(text) + 1 AS BIGINT) AS length, sha256(text || chr(10)) AS digest FROM documents")
def _(spark, sf):
    files = tables.read_tree(spark, document_files(spark, sf), size_limit=2**40, glob="*.txt")
    return files.select("length", F.sha2("content", 256).alias("digest"))


@query("detect_files", f"{O.findings(PII, 'SELECT CAST(doc_id AS VARCHAR) AS id, text || chr(10) AS text FROM documents')} "
       "SELECT rule, line, start_byte, end_byte, matched, count(*) AS files FROM f GROUP BY ALL")
def _(spark, sf):
    findings, _ = scan.scan_files(spark, document_files(spark, sf), PII, size_limit=2**40, skip_binary=False)
    return findings.groupBy("rule", "line", "start_byte", "end_byte", "matched").agg(F.count("*").alias("files"))


@query("detect_files_stats", "SELECT unnest(['files_total', 'files_scanned', 'files_by_extension']) AS metric, "
       "unnest(['', '', 'txt']) AS key, count(*) AS value FROM documents")
def _(spark, sf):
    return scan.scan_files(spark, document_files(spark, sf), PII, size_limit=2**40, skip_binary=False)[1]


def put_file(spark, path, text):
    """Write a small file, hidden ones too, through Spark's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(text.encode()))
    stream.close()


@query("detect_files_ignored", O.findings(PII, "SELECT CAST(doc_id AS VARCHAR) AS id, text || chr(10) AS text FROM documents "
                                     "WHERE lang IS NULL OR lang NOT IN ('de', 'es')")
       + " SELECT rule, line, start_byte, end_byte, matched, count(*) AS files FROM f GROUP BY ALL")
def _(spark, sf):
    """A tree with a folder a language and both ignore files."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    sinks.write_tree(table(spark, sf, "documents"), path, folder="lang")
    put_file(spark, f"{path}/.scanignore", "# German is scanned elsewhere\n*/lang=de/*\n\n!*/lang=de/keep*\n")
    put_file(spark, f"{path}/.gitignore", "*/lang=e[!a-rt-z]/part-*\n")
    findings, _ = scan.scan_files(spark, path, PII, size_limit=2**40, skip_binary=False)
    return findings.groupBy("rule", "line", "start_byte", "end_byte", "matched").agg(F.count("*").alias("files"))


@query("sarif_documents", f"{O.findings(PII, DOCS)}, r AS (SELECT id, fingerprint, start_byte, rule, {_LEVEL} AS level, CAST(json_object('ruleId', rule, "
       f"'level', {_LEVEL}, 'message', json_object('text', description), 'locations', json_array(json_object('physicalLocation', "
       "json_object('artifactLocation', json_object('uri', id), 'region', json_object('startLine', line, "
       "'startColumn', start_byte + 1))))) AS VARCHAR) AS result FROM f), "
       "x AS (SELECT id, string_agg(result, ',' ORDER BY fingerprint, start_byte) AS results FROM r GROUP BY id), "
       "y AS (SELECT id, string_agg('{\"id\":\"' || rule || '\",\"name\":\"' || rule || '\",\"defaultConfiguration\":{\"level\":\"' || level || '\"}}', ',' "
       "ORDER BY rule) AS rules FROM (SELECT DISTINCT id, rule, level FROM r) GROUP BY id) "
       f"SELECT x.id, 0 AS part, '{{\"version\":\"{sinks.SARIF_VERSION}\",\"runs\":[{{\"tool\":{{\"driver\":{{\"name\":\"{sinks.TOOL_NAME}\",\"version\":\"{sinks.TOOL_VERSION}\","
       "\"rules\":[' || rules || ']}},\"results\":[' || results || ']}]}' AS document FROM x JOIN y ON x.id = y.id")
def _(spark, sf):
    return sinks.sarif_documents(detect(documents(spark, sf), PII))


@query("findings_report", f"{O.findings(TEXT, DOCS)} SELECT id, '[' || upper(severity) || '] ' || rule || ' at ' || id || ':' "
       "|| line || ':' || start_byte AS headline, 'Matched: ' || CASE WHEN strlen(matched) > 60 AND length(matched) > 60 "
       "THEN substr(matched, 1, 60) || '...' ELSE matched END AS matched_line FROM f")
def _(spark, sf):
    return sinks.report_lines(detect(documents(spark, sf), TEXT))


# --- filters -----------------------------------------------------------------------------------
@query("filter_size", f"WITH c AS ({DOCS}) SELECT id, strlen(text) AS bytes FROM c WHERE strlen(text) <= 2048")
def _(spark, sf):
    return filters.filter_size(documents(spark, sf), 2048).select("id", F.octet_length("text").cast("bigint").alias("bytes"))


_WITH_NUL = "CASE WHEN lang = 'de' THEN text || chr(0) ELSE text END"


@query("filter_binary", f"WITH c AS ({O.content('documents', 'doc_id', '(' + _WITH_NUL + ')')}) "
       "SELECT id FROM c WHERE NOT contains(text[1:8192], chr(0))")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.expr(_WITH_NUL))
    return filters.filter_binary(content_table(d, "doc_id", "text")).select("id")


_PATH = "source || '/' || CASE lang WHEN 'es' THEN 'node_modules' ELSE lang END || '/' || doc_id || CASE lang WHEN 'fr' THEN '.log' ELSE '.md' END"
_GLOBS = filters.ignore_globs("# notes\n*.log\n\n!keep.log\n*/de/?[0-4]*.md\n")


@query("filter_ignored", f"SELECT path FROM (SELECT {_PATH} AS path FROM documents) WHERE NOT list_has_any("
       "string_split(path, '/'), ['node_modules', 'target', '.git'])"
       + "".join(f" AND NOT regexp_matches(path, {O.q(filters.glob_to_regex(g))})" for g in _GLOBS))
def _(spark, sf):
    paths = table(spark, sf, "documents").select(F.expr(_PATH).alias("path"))
    return filters.filter_ignored(paths, _GLOBS)


_RULE_COUNT = "SELECT rule, CAST(sum(n) AS BIGINT) AS matches FROM graded GROUP BY rule"


def per_rule(rows):
    return rows.groupBy("rule").agg(F.sum("n").alias("matches"))


@query("filter_category", f"{O.counts([r for r in ALL if r['category'] in ('pii', 'web_development')], PAGES)} {_RULE_COUNT}")
def _(spark, sf):
    chosen = catalog.filter_category(catalog.rules_frame(spark, ALL), ["pii", "web-development"])
    return per_rule(counted(pages(spark, sf), catalog.collect_rules(chosen)))


@query("filter_severity", f"{O.counts([r for r in TEXT if r['severity'] in ('critical', 'high')], DOCS)} {_RULE_COUNT}")
def _(spark, sf):
    chosen = catalog.filter_severity(catalog.rules_frame(spark, TEXT), "high")
    return per_rule(counted(documents(spark, sf), catalog.collect_rules(chosen)))


@query("filter_confidence", f"{O.counts([r for r in TEXT if r['confidence'] in ('high', 'medium')], DOCS)} {_RULE_COUNT}")
def _(spark, sf):
    chosen = catalog.filter_confidence(catalog.rules_frame(spark, TEXT), "medium")
    return per_rule(counted(documents(spark, sf), catalog.collect_rules(chosen)))


@query("filter_env_only", f"{O.counts([r for r in load_catalogue(['finance', 'pii']) if not r['env_var']], DOCS)} {_RULE_COUNT}")
def _(spark, sf):
    chosen = catalog.filter_env_only(catalog.rules_frame(spark, load_catalogue(["finance", "pii"])))
    return per_rule(counted(documents(spark, sf), catalog.collect_rules(chosen)))


_ON = ("email-address", "iban")
_OFF = ("jailbreak-attempt",)


@query("filter_enabled", O.counts(
    [r for r in TEXT if (r["category"] != "pii" or r["name"] in _ON) and r["name"] not in _OFF], DOCS) + " " + _RULE_COUNT)
def _(spark, sf):
    rules = catalog.rules_frame(spark, TEXT)
    by_category = spark.createDataFrame([("pii", False)], "category string, enabled boolean")
    by_rule = spark.createDataFrame([(n, True) for n in _ON] + [(n, False) for n in _OFF], "name string, enabled boolean")
    chosen = catalog.filter_enabled(catalog.apply_overrides(rules, by_rule, by_category))
    return per_rule(counted(documents(spark, sf), catalog.collect_rules(chosen)))


@query("severity_override", f"{_TEXT_GRADED} SELECT severity, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT n, CASE category "
       "WHEN 'pii' THEN 'critical' WHEN 'llm-guardrails' THEN 'low' ELSE severity END AS severity FROM g0) GROUP BY severity")
def _(spark, sf):
    overrides = spark.createDataFrame([("pii", "critical"), ("llm_guardrails", "low")], "category string, severity string")
    return risk.findings_by_severity(catalog.override_severity(counted(documents(spark, sf), TEXT), overrides))


_PROFILE = profiles.preset("production")


@query("apply_profile", f"{O.counts(active_rules(_PROFILE.rules(ALL)), DOCS + ' WHERE strlen(text) <= 5242880 AND NOT contains(text[1:8192], chr(0))')} "
       "SELECT id, rule, CAST(n AS BIGINT) AS n FROM graded")
def _(spark, sf):
    return counted(_PROFILE.content(documents(spark, sf)), active_rules(_PROFILE.rules(ALL))).select("id", "rule", "n")


@query("gate_passes", f"{_TEXT_GRADED} SELECT c.id, coalesce(max({O.severity_rank('severity')}), 0) < 3 AS passes "
       "FROM c LEFT JOIN g0 ON c.id = g0.id GROUP BY c.id")
def _(spark, sf):
    content = documents(spark, sf)
    return filters.gate_passes(counted(content, TEXT), "high", content)


# --- catalogue: parts stand for authored rules --------------------------------------------------
_SEV = ["crit", "MED", "High", "low", "odd", "critical"]
_PART_RULE = {
    "ordinal": "CAST(p_partkey AS INTEGER)", "name": "p_name", "category": "p_brand", "match": "lower(p_type)",
    "enabled": "(p_size > 10)",
    "severity": "CASE " + " ".join(f"WHEN p_size < {8 * (i + 1)} THEN '{s}'" for i, s in enumerate(_SEV)) + " ELSE 'medium' END",
    "confidence": "CASE WHEN p_size < 20 THEN 'med' WHEN p_size < 35 THEN 'HIGH' ELSE 'unsure' END",
    "description": "p_type",
}
_PART_SQL = "SELECT " + ", ".join(f"{v} AS {k if k != 'match' else 'pattern'}" for k, v in _PART_RULE.items()) + " FROM part"


def part_rules(spark, sf):
    rows = table(spark, sf, "part").select(*[F.expr(v).alias(k) for k, v in _PART_RULE.items()])
    empty = {"min_entropy": "double", "reference": "string", "tags": "array<string>"}
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()],
                       F.lit(False).alias("env_var"), F.lit(False).alias("binary"))


_NORMAL_S = ("CASE WHEN lower(severity) = 'crit' THEN 'critical' WHEN lower(severity) = 'med' THEN 'medium' "
             "WHEN lower(severity) IN ('critical', 'high', 'medium', 'low') THEN lower(severity) ELSE 'medium' END")
_NORMAL_C = ("CASE WHEN lower(confidence) = 'med' THEN 'medium' WHEN lower(confidence) IN ('high', 'medium', 'low') "
             "THEN lower(confidence) ELSE 'medium' END")


@query("rules_normalize", f"SELECT name, ordinal, {_NORMAL_S} AS severity, {_NORMAL_C} AS confidence FROM ({_PART_SQL})")
def _(spark, sf):
    return catalog.normalize(part_rules(spark, sf)).select("name", "ordinal", "severity", "confidence")


@query("rules_validate", f"SELECT name AS rule, 'duplicate name' AS problem FROM ({_PART_SQL}) GROUP BY name HAVING count(*) > 1 "
       f"UNION ALL SELECT name, 'empty pattern' FROM ({_PART_SQL}) WHERE CASE WHEN enabled THEN pattern ELSE '' END = ''")
def _(spark, sf):
    return catalog.validate(part_rules(spark, sf).withColumn("match", F.expr("if(enabled, match, '')")))


_BROKEN = "CASE WHEN ordinal % 7 = 3 THEN pattern || '(' WHEN ordinal % 11 = 5 THEN '' ELSE pattern END"


@query("rules_refused", f"WITH p AS (SELECT ordinal, name, {_BROKEN} AS m FROM ({_PART_SQL})), g AS (SELECT *, CASE WHEN m = '' "
       "THEN 'empty pattern' WHEN suffix(m, '(') THEN 'does not compile' END AS problem FROM p), "
       "u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS k FROM g WHERE problem IS NULL) "
       "SELECT name AS rule, problem FROM g WHERE problem IS NOT NULL UNION ALL SELECT name, 'duplicate name' FROM u WHERE k > 1")
def _(spark, sf):
    """Rules that a scan leaves out, and why, from a scan of the documents by rules of which some are broken."""
    rules, refused = part_rules(spark, sf).withColumn("match", F.expr(_BROKEN.replace("pattern", "match"))), []
    scan.scan_rule_table(documents(spark, sf), rules, refused)
    told = spark.createDataFrame(refused, "rule string, why string")
    return told.select("rule", F.when(F.col("why").isin("empty pattern", "duplicate name"), F.col("why")).otherwise(
        "does not compile").alias("problem"))


@query("catalog_rule_listing", f"{O.counts(ALL, DOCS)}, h AS (SELECT rule, count(DISTINCT id) AS rows, CAST(sum(n) AS BIGINT) AS matches "
       "FROM graded GROUP BY rule) SELECT m.rule AS name, category, severity, confidence, coalesce(rows, 0) AS rows, "
       "coalesce(matches, 0) AS matches FROM meta m LEFT JOIN h ON m.rule = h.rule")
def _(spark, sf):
    """Every rule of the catalogue, with what it finds in the documents."""
    index = build_index(ALL)
    hits = risk.rule_hits(match_counts(documents(spark, sf), index), index).withColumnRenamed("rule", "name")
    rules = catalog.listing(catalog.rules_frame(spark, ALL)).select("name", "category", "severity", "confidence")
    return rules.join(hits, "name", "left").select(*rules.columns, F.coalesce("rows", F.lit(0)).alias("rows"),
                                                   F.coalesce("matches", F.lit(0)).alias("matches"))


@query("rules_merge", f"WITH p AS ({_PART_SQL}), s AS (SELECT CAST(s_suppkey AS INTEGER) AS ordinal, s_name AS name FROM supplier) "
       "SELECT name, ordinal FROM s UNION ALL SELECT name, ordinal + (SELECT max(ordinal) + 1 FROM s) FROM p")
def _(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("ordinal"), F.col("s_name").alias("name"))
    return catalog.merge_packs(suppliers, part_rules(spark, sf).select("ordinal", "name")).select("name", "ordinal")


_FIELDS = "CAST(ordinal AS VARCHAR), name, category, pattern, CAST(enabled AS VARCHAR), severity, confidence, '', description, '', '', 'false', 'false'"


@query("bundle_metadata", f"SELECT 2 AS schema_version, '2024-01-01' AS created_at, count(*) AS pattern_count, sha256(string_agg("
       f"concat_ws(chr(31), {_FIELDS}), chr(10) ORDER BY ordinal, name)) AS checksum FROM ({_PART_SQL})")
def _(spark, sf):
    return catalog.bundle_metadata(part_rules(spark, sf), created_at="2024-01-01")


@query("rules_bundle_round_trip", f"SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, name, category, pattern AS match, "
       f"enabled, severity, confidence, description FROM ({_PART_SQL})")
def _(spark, sf):
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    sinks.write_bundle(part_rules(spark, sf), path, created_at="2024-01-01")
    return tables.read_rules(spark, path).select(
        "ordinal", "name", "category", "match", "enabled", "severity", "confidence", "description")


@query("catalog_listing", f"SELECT name, category, severity, confidence, enabled, description FROM ({_PART_SQL}) "
       "WHERE enabled AND category = 'Brand#1'")
def _(spark, sf):
    return catalog.listing(part_rules(spark, sf), "Brand#1", include_disabled=False)


@query("catalog_categories", f"SELECT DISTINCT category FROM ({_PART_SQL})")
def _(spark, sf):
    return catalog.categories(part_rules(spark, sf))


@query("catalog_search", f"SELECT name, category FROM ({_PART_SQL}) WHERE contains(lower(name), 'widget') "
       "OR contains(lower(description), 'widget')")
def _(spark, sf):
    return catalog.search(part_rules(spark, sf), "WIDGET").select("name", "category")


@query("catalog_stats", f"SELECT category, " + ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
       + f", count(*) AS total FROM (SELECT category, {_NORMAL_S} AS severity FROM ({_PART_SQL})) GROUP BY category")
def _(spark, sf):
    return catalog.statistics(catalog.normalize(part_rules(spark, sf)))


@query("custom_rules", "SELECT CAST(d.doc_id AS VARCHAR) AS id, 'passage-' || item_id AS rule, "
       "CAST((strlen(d.text) - strlen(replace(d.text, b.text, ''))) // strlen(b.text) AS BIGINT) AS n "
       "FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def _(spark, sf):
    passages = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("int").alias("ordinal"), F.concat(F.lit("passage-"), "item_id").alias("name"),
        F.lit("passages").alias("category"),
        F.regexp_replace("text", r"([\\\[\](){}.*+?^$|])", r"\\$1").alias("match"), F.lit(True).alias("enabled"),
        F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.lit(None).cast("double").alias("min_entropy"),
        F.lit("known passage").alias("description"), F.lit(None).cast("string").alias("reference"),
        F.array(F.lit("passages")).alias("tags"), F.lit(False).alias("env_var"), F.lit(False).alias("binary"))
    found = scan.scan_rule_table(documents(spark, sf), passages)
    return found.groupBy("id", "rule").agg(F.count("*").alias("n"))


# --- scalar functions ---------------------------------------------------------------------------
@query("fn_shannon_entropy", f"SELECT doc_id, round({O.entropy('text')}, 9) AS entropy FROM documents")
def _(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.expr(f"round({scalars.shannon_entropy('text')}, 9)").alias("entropy"))


@query("fn_entropy_base", f"SELECT doc_id, round({O.entropy('text', '10.0')} / ln(10.0), 9) AS entropy FROM documents")
def _(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.expr(f"round({scalars.entropy_base('text', '10D')}, 9)").alias("entropy"))


_DENSITY = "(CASE WHEN text = '' THEN 0 ELSE len(list_distinct(regexp_extract_all(text, '(?s).')))::DOUBLE / strlen(text) END)"


@query("fn_information_density", f"SELECT doc_id, round({_DENSITY}, 9) AS density FROM documents")
def _(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.expr(f"round({scalars.information_density('text')}, 9)").alias("density"))


@query("fn_guessability", f"SELECT doc_id, round({O.entropy('text')} / 8 * 70 + {_DENSITY} * 30, 9) AS score FROM documents")
def _(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.expr(f"round({scalars.guessability('text')}, 9)").alias("score"))


@query("fn_classify_entropy", "SELECT doc_id, CASE WHEN e < 2 THEN 'very_low' WHEN e < 3 THEN 'low' WHEN e < 4 THEN 'medium' "
       f"WHEN e < 5 THEN 'high' ELSE 'very_high' END AS class FROM (SELECT doc_id, {O.entropy('text')} AS e FROM documents)")
def _(spark, sf):
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.expr(scalars.shannon_entropy("text")).alias("e"))
    return rows.select("doc_id", F.expr(scalars.classify_entropy("e")).alias("class"))


# words of the documents, with the digests of their texts
_WORDS = ("SELECT DISTINCT unnest(list_concat(string_split_regex(text, '\\s+'), "
          "[md5(text), sha256(text), to_base64(encode(lang || doc_id))])) AS w FROM documents")


def words(spark, sf):
    d = table(spark, sf, "documents")
    extra = F.array(F.md5("text"), F.sha2("text", 256), F.base64(F.encode(F.concat("lang", F.col("doc_id").cast("string")), "UTF-8")))
    return d.select(F.explode(F.concat(F.split("text", r"[\t\n\f\r ]+"), extra)).alias("w")).distinct()


@query("fn_is_base64", f"SELECT w, strlen(w) >= 4 AND regexp_matches(w, '^[A-Za-z0-9+/=]+\\z') AND (suffix(w, '=') OR "
       f"(length(regexp_replace(w, '[^A-Za-z]', '', 'g')) / strlen(w) > 0.5 AND strlen(w) % 4 = 0)) AS base64 FROM ({_WORDS})")
def _(spark, sf):
    return words(spark, sf).select("w", F.expr(scalars.is_base64("w")).alias("base64"))


@query("fn_is_hex", f"SELECT w, strlen(w) >= 4 AND strlen(w) % 2 = 0 AND regexp_matches(w, '^[0-9A-Fa-f]+\\z') AS hex FROM ({_WORDS})")
def _(spark, sf):
    return words(spark, sf).select("w", F.expr(scalars.is_hex("w")).alias("hex"))


@query("fn_severity_weight", f"SELECT name, {O.severity_weight('severity')} AS weight, "
       + O.case_of("confidence", {"high": "1.0", "medium": "0.7", "low": "0.4"}, "0.5")
       + f"::DOUBLE AS multiplier FROM (SELECT name, {_NORMAL_S} AS severity, confidence FROM ({_PART_SQL}))")
def _(spark, sf):
    rows = part_rules(spark, sf).withColumn("severity", F.expr(scalars.normalize_severity("severity")))
    return rows.select("name", F.expr(scalars.severity_weight("severity")).alias("weight"),
                       F.expr(scalars.confidence_multiplier("confidence")).alias("multiplier"))


@query("fn_confidence_multiplier", "SELECT name, " + O.case_of(
    "confidence", {"high": "1.0", "medium": "0.7", "low": "0.4"}, "0.5") + f"::DOUBLE AS multiplier "
       f"FROM (SELECT name, {_NORMAL_C} AS confidence FROM ({_PART_SQL}))")
def _(spark, sf):
    rows = catalog.normalize(part_rules(spark, sf))
    return rows.select("name", F.expr(scalars.confidence_multiplier("confidence")).alias("multiplier"))


@query("sql_functions", f"SELECT doc_id, round({O.entropy('text')}, 6) AS entropy, round({_DENSITY}, 6) AS density, "
       f"{O.risk_level('n_chars')} AS level, 'r:' || doc_id || ':1:' || lang AS fingerprint FROM documents")
def _(spark, sf):
    scalars.register_functions(spark)
    docs = spread(table(spark, sf, "documents"))
    return spark.sql("select doc_id, round(sw_shannon_entropy(text), 6) entropy, round(sw_information_density(text), 6) density, "
                     "sw_risk_level(n_chars) level, sw_fingerprint('r', string(doc_id), 1, lang) fingerprint from {docs}", docs=docs)


_SCORED = "SELECT event_id, CAST(floor(value) AS BIGINT) - 5 AS score FROM events"


@query("fn_risk_level", f"SELECT event_id, {O.risk_level('score')} AS level, "
       + O.case_of(O.risk_level("score"), {"none": 0, "low": 1, "medium": 2, "high": 3}, 4) + " AS rank, CASE "
       + O.risk_level("score") + " WHEN 'none' THEN 'No risk detected' WHEN 'low' THEN 'Low' WHEN 'medium' THEN 'Medium' "
       "WHEN 'high' THEN 'High' ELSE 'CRITICAL' END || CASE WHEN score <= 0 THEN '' ELSE ' risk - 1 findings, score: ' || score END "
       f"AS description FROM ({_SCORED})")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.floor("value") - 5).alias("score"))
    rows = rows.withColumn("level", F.expr(scalars.risk_level("score")))
    return rows.select("event_id", "level", F.expr(scalars.risk_level_value("level")).alias("rank"),
                       F.expr(scalars.risk_description("level", "1", "score")).alias("description"))


@query("fn_sarif_level", f"SELECT name, {_LEVEL} AS level FROM (SELECT name, lower(severity) AS severity FROM ({_PART_SQL}))")
def _(spark, sf):
    return part_rules(spark, sf).select("name", F.expr(scalars.sarif_level("lower(severity)")).alias("level"))


_EXTENSIONS = sorted(LANGUAGES) + ["md", "txt"]
_FILE = ("source || '/' || doc_id || '.' || " + "CASE doc_id % {n} ".format(n=len(_EXTENSIONS))
         + " ".join(f"WHEN {i} THEN '{e if i % 2 else e.upper()}'" for i, e in enumerate(_EXTENSIONS)) + " END")


@query("fn_language", f"SELECT path, " + O.case_of(
    "lower(regexp_extract(path, '\\.([^./]+)\\z', 1))", {k: O.q(v) for k, v in LANGUAGES.items()}, "NULL")
       + f" AS language FROM (SELECT {_FILE} AS path FROM documents)")
def _(spark, sf):
    paths = table(spark, sf, "documents").select(F.expr(_FILE).alias("path"))
    return paths.select("path", F.expr(scalars.language("path")).alias("language"))


# --- source code: the pages, taken as files -------------------------------------------------------
def _lint_sql(source, rules, word_filter="TRUE"):
    rows = " UNION ALL ".join(
        f"SELECT id, CAST(i AS INTEGER) AS line, l AS matched, {O.q(rule)} AS rule, {O.q(sev)} AS severity FROM ls WHERE {cond}"
        for rule, sev, cond in rules)
    return (f"WITH c AS ({source}), ls AS MATERIALIZED (SELECT id, a[i] AS l, regexp_replace(a[i], '^\\s+|\\s+$', '', 'g') AS t, i "
            f"FROM (SELECT id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT id, {O.lines('text')} AS a FROM c))) {rows}")


def _contains(x, wordlist):
    return "(" + " OR ".join(f"contains({x}, {O.q(w)})" for w in wordlist) + ")"


def _starts(x, wordlist):
    return "(" + " OR ".join(f"starts_with({x}, {O.q(w)})" for w in wordlist) + ")"


_COMMON = [
    ("debug-artifact", "low", _contains("t", code.DEBUG_OUTPUT)),
    ("hardcoded-host", "low", _contains("t", code.LOCAL_HOSTS) + " AND NOT " + _starts("t", ("//", "#", "/*")) + " AND strlen(t) > 5"),
    ("dangerous-execution", "high", _contains("t", code.DYNAMIC_CODE)),
]
# page markup with statement endings on lines of their own, and the calls the lints look for
_CODE = ("replace(replace(replace(replace(html, ';', ';' || chr(10)), 'track(', 'print('), '<article>', chr(10) || "
         "'out := exec.Command(localhost, password, eval(' || chr(10)), '<nav>', chr(10) || '  unsafe { x.unwrap() }' || chr(10) "
         "|| '  // unsafe .expect(' || chr(10))")
_CODE_SQL = O.content("pages", "page_id", f"({_CODE})")


def code_rows(spark, sf):
    return content_table(table(spark, sf, "pages").withColumn("html", F.expr(_CODE.replace("chr(10)", "'\\n'"))), "page_id", "html")


LINT = ["id", "line", "matched", "rule", "severity"]


@query("lint_common", _lint_sql(_CODE_SQL, _COMMON))
def _(spark, sf):
    return code.lint_common(code_rows(spark, sf)).select(LINT)


@query("lint_go", _lint_sql(_CODE_SQL, [
    ("command-injection", "high", "contains(l, 'exec.Command') AND NOT starts_with(l, '//') AND NOT " + _starts("t", ("//", "/*"))),
    ("hardcoded-credentials", "high", "contains(l, ':=') AND " + _contains("l", code.SECRET_WORDS))]))
def _(spark, sf):
    return code.lint_go(code_rows(spark, sf)).select(LINT)


_NOT_COMMENT = "NOT " + _starts("t", ("//", "/*", "*/"))


@query("lint_rust", _lint_sql(_CODE_SQL, [
    ("unsafe-code", "medium", f"{_NOT_COMMENT} AND contains(t, 'unsafe ')"),
    ("panic-possible", "medium", f"{_NOT_COMMENT} AND " + _contains("t", (".unwrap()", ".expect(")))]))
def _(spark, sf):
    return code.lint_rust(code_rows(spark, sf)).select(LINT)


def _complexity_sql(source):
    go = " + ".join(O.occurrences("text", w) for w in code.BRANCH_WORDS["go"])
    return (f"WITH c AS ({source}) SELECT id, 'go' AS language, CAST({go} AS INTEGER) AS cyclomatic, "
            f"CAST({O.line_count('text')} AS INTEGER) AS loc, {_contains('text', code.TODO_WORDS)} AS has_todo FROM c")


@query("code_complexity", _complexity_sql(DOCS))
def _(spark, sf):
    return code.code_complexity(documents(spark, sf), "'go'").select("id", "language", "cyclomatic", "loc", "has_todo")


# page markup with function heads, branches and comments on lines of their own
_RUST = ("replace(replace(replace(html, '<p>', chr(10) || 'fn go(a: i32, b: i32) { if x || y {' || chr(10)), '</p>', chr(10) || "
         "'  // fn no(a, b, c, d) if for TODO' || chr(10) || 'for x in y { match z' || chr(10)), '<h1>', chr(10) || 'fn none() {}' || chr(10) || "
         "'pub fn wide(a, b, c, d, e) { // FIXME' || chr(10) || 'fn three(a, b, c)' || chr(10))")


def _rust_sql():
    count = " + ".join(O.occurrences("body", w) for w in code.BRANCH_WORDS["rust"])
    trimmed = "regexp_replace(l, '^\\s+|\\s+$', '', 'g')"
    kept = f"array_to_string(list_filter({O.lines('text')}, lambda l: NOT (starts_with({trimmed}, '//') OR starts_with({trimmed}, '/*'))), chr(10))"
    inside = "split_part(substr(l, instr(l, '(') + 1), ')', 1)"
    width = (f"CASE WHEN contains(l, 'fn ') AND NOT contains(l, '//') AND instr(l, '(') > 0 AND instr(l, ')') > instr(l, '(') + 1 "
             f"THEN {O.occurrences(inside, ',')} + 1 ELSE 0 END")
    return (f"WITH c AS ({O.content('pages', 'page_id', _RUST)}), b AS (SELECT *, {kept} AS body FROM c) SELECT id, 'rust' AS language, "
            f"CAST({count} AS INTEGER) AS cyclomatic, 0 AS cognitive, CAST({O.line_count('text')} AS INTEGER) AS loc, "
            f"CAST(list_max(list_transform(string_split(body, chr(10)), lambda l: {width})) AS INTEGER) AS param_count, 0 AS max_nesting, "
            f"FALSE AS has_early_return, {_contains('body', code.TODO_WORDS)} AS has_todo FROM b")


@query("code_complexity_rust", _rust_sql())
def _(spark, sf):
    rows = table(spark, sf, "pages").withColumn("html", F.expr(_RUST.replace("chr(10)", "'\n'")))
    return code.code_complexity(content_table(rows, "page_id", "html"), "'rust'")


_FLOW = (f"WITH c AS ({_CODE_SQL}), ls AS (SELECT id, i AS line, regexp_replace(a[i], '^\\s+|\\s+$', '', 'g') AS t FROM ("
         f"SELECT id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT id, {O.lines('text')} AS a FROM c))), "
         "s AS (SELECT id, line, t, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM ls "
         "WHERE t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '/*')), "
         "n AS (SELECT c.id, count(s.k) AS n FROM c LEFT JOIN s ON c.id = s.id GROUP BY c.id) ")
_KIND_SQL = ("CASE WHEN starts_with(t, 'if') OR starts_with(t, 'match') THEN 'conditional' WHEN starts_with(t, 'for') OR "
             "starts_with(t, 'while') THEN 'loop' WHEN starts_with(t, 'try') OR contains(t, 'try {') THEN 'try' "
             "WHEN starts_with(t, 'return') OR starts_with(t, '->') THEN 'return' WHEN starts_with(t, 'panic') OR "
             "contains(t, 'panic!') THEN 'unwind' ELSE 'statement' END")


@query("flow_nodes", _FLOW + f"SELECT id, CAST(k AS INTEGER) AS node_id, {_KIND_SQL} AS kind, CAST(line AS INTEGER) AS line FROM s "
       "UNION ALL SELECT id, 0, 'entry', 1 FROM c UNION ALL SELECT n.id, CAST(n + 1 AS INTEGER), 'exit', "
       f"CAST({O.line_count('text')} AS INTEGER) FROM n JOIN c ON n.id = c.id")
def _(spark, sf):
    return code.flow_nodes(code_rows(spark, sf))


@query("flow_edges", _FLOW + "SELECT id, CAST(src AS INTEGER) AS src, CAST(src + 1 AS INTEGER) AS dst FROM ("
       "SELECT id, unnest(generate_series(0, n)) AS src FROM n WHERE n > 0)")
def _(spark, sf):
    return code.flow_edges(code_rows(spark, sf))


def _resource_sql():
    kinds = ((1, "file", code.OPEN_FILE, code.CLOSE_FILE), (2, "mutex", code.OPEN_LOCK, code.CLOSE_LOCK),
             (3, "transaction", code.OPEN_WORK, code.CLOSE_WORK))
    holds = lambda words: " OR ".join(f"contains(l, {O.q(w)})" for w in words)
    events = " UNION ALL ".join(
        f"SELECT id, line, {k} AS k, '{name}' AS name, CASE WHEN {holds(opens)} THEN 1 WHEN {holds(closes)} THEN -1 END AS step FROM l"
        for k, name, opens, closes in kinds)
    return (
        "WITH RECURSIVE c AS (SELECT CAST(page_id AS VARCHAR) AS id, regexp_replace(replace(html, '<ul>', chr(10) || 'fopen(' || chr(10) "
        "|| 'BEGIN' || chr(10)), '</ul>|</p>', chr(10) || 'close(' || chr(10), 'g') AS text FROM pages), "
        "l AS (SELECT id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM c), "
        f"e AS MATERIALIZED (SELECT id, name, line, step, row_number() OVER (PARTITION BY id ORDER BY line, k) AS pos FROM ({events}) "
        "WHERE step IS NOT NULL), "
        # the stack itself, event by event
        "r AS (SELECT id, 0::BIGINT AS pos, []::STRUCT(name VARCHAR, line BIGINT)[] AS stack, NULL::STRUCT(name VARCHAR, line BIGINT) AS top, "
        "NULL::BIGINT AS release FROM c UNION ALL SELECT r.id, e.pos, CASE WHEN step = 1 THEN list_append(stack, "
        "{'name': e.name, 'line': e.line::BIGINT}) ELSE stack[:-2] END, CASE WHEN step = -1 THEN stack[-1] END, e.line::BIGINT "
        "FROM r JOIN e ON r.id = e.id AND e.pos = r.pos + 1) "
        "SELECT id, top.name AS name, CAST(top.line AS INTEGER) AS acquire_line, CAST(release AS INTEGER) AS release_line FROM r "
        "WHERE top IS NOT NULL UNION ALL SELECT id, x.name, CAST(x.line AS INTEGER), NULL FROM ("
        "SELECT id, unnest(stack) AS x FROM (SELECT id, arg_max(stack, pos) AS stack FROM r GROUP BY id))")


@query("resource_pairs", _resource_sql())
def _(spark, sf):
    opened = F.regexp_replace(F.regexp_replace("html", "<ul>", "\nfopen(\nBEGIN\n"), "</ul>|</p>", "\nclose(\n")
    rows = content_table(table(spark, sf, "pages").withColumn("html", opened), "page_id", "html")
    return code.resource_pairs(rows)


# --- clones --------------------------------------------------------------------------------------
_KEY_SQL = "(" + ", ".join(O.q(k) for k in clones.KEYWORDS) + ")"
_FOLD_SQL = (f"CASE WHEN x IN {_KEY_SQL} THEN x WHEN regexp_matches(x, '^[\\p{{L}}_]') THEN 'ID' WHEN regexp_matches(x, '^\\p{{N}}') "
             "THEN 'NUM' WHEN x[1] IN ('\"', '''') THEN 'STR' ELSE x END")
def _blocks(source, keys="", left="", pair="", on=""):
    return (f"WITH c AS ({source}), t AS MATERIALIZED (SELECT id, list_transform(regexp_extract_all(text, {O.q(clones.token_pattern(False))}), "
               f"lambda x: {_FOLD_SQL}) AS ts FROM c), b AS MATERIALIZED (SELECT id, CAST(k // 10 AS INTEGER) AS block, ts[k + 1:k + 20] AS part FROM ("
               "SELECT id, ts, unnest(generate_series(0, len(ts) - 21, 10)) AS k FROM t WHERE len(ts) > 20)), "
               f"g AS MATERIALIZED (SELECT {keys} list_sort(list_distinct(part)) AS s, count(*) AS n FROM b GROUP BY ALL), "
               f"p AS (SELECT {left} n AS n1, n AS n2, 1.0 AS similarity, n * (n - 1) // 2 AS pairs, s AS s1, s AS s2 FROM g WHERE n > 1 UNION ALL "
               f"SELECT {pair} x.n, y.n, len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), "
               f"x.n * y.n, x.s, y.s FROM g x JOIN g y ON {on} x.s < y.s) ")
_TYPE_SQL = "CASE WHEN similarity >= 0.98 THEN 1 WHEN similarity >= 0.85 THEN 2 WHEN similarity >= 0.75 THEN 3 ELSE 4 END"
_IN_FILE = dict(keys="id,", left="id,", pair="x.id,", on="x.id = y.id AND")


_LINED = (f"WITH c AS ({DOCS}), m AS (SELECT id, regexp_extract_all(text, {O.q(clones.token_pattern(False))}) AS m, "
          f"string_split_regex(text, {O.q(clones.token_pattern(False))}) AS g FROM c), "
          "u AS (SELECT id, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, unnest(generate_series(0, len(m) - 1)) AS k FROM m WHERE len(m) > 20), "
          f"t AS MATERIALIZED (SELECT id, k, {_FOLD_SQL} AS x, CAST(1 + sum(length(gap) - length(replace(gap, chr(10), ''))) OVER o "
          "+ coalesce(sum(length(x) - length(replace(x, chr(10), ''))) OVER p, 0) AS INTEGER) AS line FROM u WINDOW "
          "o AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING), "
          "p AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
          "l AS MATERIALIZED (SELECT id, list(x ORDER BY k) AS ts, list(line ORDER BY k) AS ls FROM t GROUP BY id), "
          "b AS MATERIALIZED (SELECT id, CAST(k // 10 AS INTEGER) AS block, ls[k + 1] AS line, ls[k + 20] AS \"end\", "
          "list_sort(list_distinct(ts[k + 1:k + 20])) AS s FROM (SELECT id, ts, ls, unnest(generate_series(0, len(ts) - 21, 10)) AS k FROM l)), "
          "q AS MATERIALIZED (SELECT DISTINCT id, s FROM b), "
          "v AS (SELECT *, len(list_intersect(s1, s2))::DOUBLE / (len(s1) + len(s2) - len(list_intersect(s1, s2))) AS similarity FROM ("
          "SELECT x.id, x.s AS s1, y.s AS s2 FROM q x JOIN q y ON x.id = y.id)) ")


@query("clone_pairs", f"{_LINED} SELECT x.id, x.block AS block1, x.line AS line1, x.\"end\" AS end1, y.block AS block2, "
       f"y.line AS line2, y.\"end\" AS end2, round(similarity, 9) AS similarity, {_TYPE_SQL} AS clone_type "
       "FROM v JOIN b x ON x.id = v.id AND x.s = v.s1 JOIN b y ON y.id = v.id AND y.s = v.s2 AND x.block < y.block WHERE similarity >= 0.75")
def _(spark, sf):
    found = clones.clone_locations(clones.clone_pairs(documents(spark, sf)))
    return found.withColumn("similarity", F.round("similarity", 9))


@query("clone_pairs_pages", _blocks(source=PAGES, **_IN_FILE)
       + "SELECT id, round(similarity, 9) AS similarity, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS set_pairs FROM p "
       "WHERE similarity >= 0.75 GROUP BY id, round(similarity, 9)")
def _(spark, sf):
    rows = clones.clone_pairs(pages(spark, sf), with_lines=False)
    return rows.groupBy("id", F.round("similarity", 9).alias("similarity")).agg(
        F.sum("pairs").alias("pairs"), F.count("*").alias("set_pairs"))


@query("clone_type", _blocks(source=DOCS, **_IN_FILE)
       + f"SELECT {_TYPE_SQL} AS clone_type, CAST(sum(pairs) AS BIGINT) AS pairs FROM p WHERE similarity >= 0.75 GROUP BY {_TYPE_SQL}")
def _(spark, sf):
    return clones.clone_pairs(documents(spark, sf), with_lines=False).groupBy("clone_type").agg(F.sum("pairs").alias("pairs"))


@query("clone_pairs_across", _blocks(source=DOCS, **_IN_FILE)
       + "SELECT array_to_string(part, ' ') AS normalized, count(*) AS blocks, count(DISTINCT id) AS files, min(id) AS first_id "
       "FROM b GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return clones.clone_groups_across(documents(spark, sf))


def _near(read, source):
    sql = (_blocks(source=source, keys="", left="", pair="", on="")
           + "SELECT array_to_string(s1, ' ') AS set1, array_to_string(s2, ' ') AS set2, n1 AS blocks1, n2 AS blocks2, "
           f"round(similarity, 9) AS similarity, {_TYPE_SQL} AS clone_type FROM p WHERE similarity >= 0.75 AND s1 <> s2")

    def run(spark, sf):
        near = clones.near_clones_across(read(spark, sf))
        return near.select(F.array_join("set1", " ").alias("set1"), F.array_join("set2", " ").alias("set2"), "blocks1", "blocks2",
                           F.round("similarity", 9).alias("similarity"), "clone_type")
    return sql, run


for _name, _read, _source in (("clone_pairs_near", documents, DOCS), ("clone_pairs_near_conversations", conversations, CHATS)):
    _sql, _run = _near(_read, _source)
    query(_name, _sql)(_run)


@query("findings_union", f"{O.findings(PII, _CODE_SQL)}, lint AS ({_lint_sql('SELECT * FROM c', _COMMON).replace('WITH c AS (SELECT * FROM c), ', 'WITH ')}) "
       "SELECT id, rule, kind, line, matched FROM f UNION ALL SELECT id, rule, 'ast', line, matched FROM lint")
def _(spark, sf):
    content = code_rows(spark, sf)
    merged = risk.findings_union(detect(content, PII), code.lint_common(content))
    return merged.select("id", "rule", "kind", "line", "matched")


# --- streams ---------------------------------------------------------------------------------------
def timed_events(spark, sf):
    d = table(spark, sf, "events")
    phone = F.concat_ws("", F.lit("caller 555-010-"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit(" "), "event_type", F.lit(" "), "props")
    return d.select(F.col("event_id").cast("string").alias("id"), phone.alias("text"), "ts")


_EVENT_TEXT = "'caller 555-010-' || lpad(CAST(user_id AS VARCHAR), 4, '0') || ' ' || event_type || ' ' || props"
_EVENT_FINDINGS = O.findings(PII, f"SELECT CAST(event_id AS VARCHAR) AS id, {_EVENT_TEXT} AS text, ts FROM events")
_EVENT_TS = " FROM f JOIN events ON f.id = CAST(event_id AS VARCHAR)"


# --- the streams themselves, run to the end of the table ---------------------------------------------
def live_events(spark, sf):
    """The events as a file stream: (id, text, ts)."""
    d = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    return d.select(F.col("event_id").cast("string").alias("id"), F.expr(_EVENT_TEXT.replace("VARCHAR", "STRING")).alias("text"),
                    F.col("ts").cast("timestamp").alias("ts"))


def drain(live, start=streams.write_findings):
    """Run a stream to the end of its input and read what it wrote."""
    folder = f"{shared_folder(live.sparkSession)}/{uuid.uuid4()}"
    start(live, f"{folder}/out", f"{folder}/log").awaitTermination()
    return live.sparkSession.read.parquet(f"{folder}/out")


@query("stream_detect", f"{_EVENT_FINDINGS} SELECT {F_LIST} FROM f")
def _(spark, sf):
    return drain(streams.stream_detect(live_events(spark, sf), PII)).select(FINDING)


# Events of one file of a part.
EVENTS_A_FILE = 20_000


def arriving(spark, sf, plan, files=4):
    """Run ``plan`` over the events as they arrive, and read what it appended; returns (rows, late rows).

    The events come in ``files`` parts by time, one a trigger, each in as many files as its size asks for.  After each
    the stream stops and goes on from its checkpoint.  Then a row from far ahead moves the watermark past all windows,
    and the earliest fifth of the events comes a second time, too late.
    """
    folder, found = f"{shared_folder(spark)}/{uuid.uuid4()}", 0
    events = table(spark, sf, "events")
    first, last, number = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    several = max(spark.sparkContext.defaultParallelism, number // files // EVENTS_A_FILE)
    cuts = [F.lit(str(first + i * (last - first) / files)).cast(events.schema["ts"].dataType) for i in range(1, files)]
    rows = events.withColumn("part", sum([F.when(F.col("ts") < c, 0).otherwise(1) for c in cuts], F.lit(0)))
    ahead = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 60 days"))
    parts = [rows.where(F.col("part") == i).drop("part").repartition(several) for i in range(files)]
    late = rows.where("part = 0").drop("part").sample(0.2, seed=1).repartition(max(1, several // 5))
    for number, part in enumerate([*parts, ahead, late, ahead]):
        # a folder a part; what a part brings is one batch, so none of its rows is late for another
        part.write.parquet(f"{folder}/in/{number}")
        live = spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
        live = live.select(F.col("event_id").cast("string").alias("id"), F.expr(_EVENT_TEXT.replace("VARCHAR", "STRING")).alias("text"),
                           F.col("ts").cast("timestamp").alias("ts"))
        running = streams.write_findings(plan(streams.stream_detect(live, PII)), f"{folder}/out", f"{folder}/log")
        running.awaitTermination()
        found += streams.late_rows(running)
    return spark.read.parquet(f"{folder}/out"), found


@query("stream_risk_windows", f"{_EVENT_FINDINGS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, "
       "time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, category, count(*) AS findings, "
       f"CAST(sum({O.hundredths('1')}) AS BIGINT) AS hundredths{_EVENT_TS} GROUP BY 1, 2, category")
def _(spark, sf):
    return arriving(spark, sf, lambda found: streams.risk_windows(found, "1 hour"))[0]


@query("stream_risk_sessions", f"{_EVENT_FINDINGS}, e AS (SELECT category, severity, confidence, ts{_EVENT_TS}), "
       "m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS "
       "(PARTITION BY category ORDER BY ts)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY category ORDER BY ts "
       "ROWS UNBOUNDED PRECEDING) AS session FROM m) SELECT min(ts) AS window_start, max(ts) + INTERVAL 5 MINUTE AS window_end, "
       f"category, count(*) AS findings, CAST(sum({O.hundredths('1')}) AS BIGINT) AS hundredths FROM k GROUP BY category, session")
def _(spark, sf):
    return arriving(spark, sf, lambda found: streams.risk_windows(found, session_gap="5 minutes"))[0]


@query("stream_dedup", f"{_EVENT_FINDINGS} SELECT DISTINCT rule || '/' || matched AS fingerprint, "
       f"time_bucket(INTERVAL 6 HOUR, ts) AS window_start{_EVENT_TS}")
def _(spark, sf):
    def plan(found):
        found = found.withColumn("fingerprint", F.concat_ws("/", "rule", "matched"))
        return streams.once_per_window(found, "6 hours").select("fingerprint", "window_start")
    last = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("last"))
    return arriving(spark, sf, plan)[0].join(last, F.col("window_start") <= F.col("last")).drop("last")  # without the row from far ahead


@query("stream_baseline", f"{_EVENT_FINDINGS} SELECT id, rule, fingerprint FROM f WHERE NOT EXISTS (SELECT 1 FROM events e "
       "WHERE f.id = CAST(e.event_id AS VARCHAR) AND e.event_type = 'error')")
def _(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"))

    baseline = f"{shared_folder(spark)}/{uuid.uuid4()}"
    found = detect(timed_events(spark, sf).join(errors, "id", "left_semi").drop("ts"), PII)
    suppress.create_baseline(found).write.parquet(baseline)
    new = lambda live, path, log: streams.write_new_findings(live, lambda: spark.read.parquet(baseline), path, log)
    return drain(streams.stream_detect(live_events(spark, sf), PII), new).select("id", "rule", "fingerprint")
