"""Detection: a content table against a rule catalogue.

The plan is a hash join, not a nested loop.  One pass of the gate expression over a row finds
which required literals it holds; these keys are joined with the rule index, and only the rules
that come out of the join run on the row.  Spark broadcasts an index of the usual size, so there
is no shuffle of the text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..plans.patterns import group_probe, to_java
from ..plans.rule_index import RuleIndex, build_index
from ..session import materialize, spread


def active_rules(rules, include_disabled=False, env=False):
    """Rules that take part in a content scan: enabled, and not meant for settings only."""
    return [r for r in rules if (include_disabled or r["enabled"]) and (env or not r["env_var"])]


def _index(rules, unicode):
    return rules if isinstance(rules, RuleIndex) else build_index(active_rules(rules), unicode)


def content_table(df, id_col, text_col, *keep) -> DataFrame:
    """(id, text) view of any table."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)


def folded(text):
    """A text in the spelling of the gate's literals: ``lower``, and the letters that it does not take to i and s."""
    for letter, plain in (("\u0130", "I"), ("\u017f", "s"), ("\u0131", "i")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.replace(F.lower(text), F.lit("\u0131"), F.lit("i"))


def _gate_keys(index):
    """Distinct required literals found in ``text``; '' stands for rules without a literal."""
    if index.gate is None:
        return F.array(F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(index.gate), F.lit(1)))
    keys = F.array_distinct(F.transform(found, lambda k: F.translate(k, "123456789", "0" * 9)))
    return F.array_append(keys, F.lit("")) if index.has_always else keys


def candidates(content, index) -> DataFrame:
    """(content columns, ordinal, pattern, min_entropy) for rules that can match the row."""
    columns = content.columns
    # the gate is evaluated inside the generator, so that no rule of the optimizer repeats it
    bound = F.flatten(F.transform(F.array(_gate_keys(index)), lambda keys: F.transform(
        keys, lambda key: F.struct(key.alias("gate_key"), keys.alias("keys")))))
    keyed = content.where(F.col("text").isNotNull()).select(*columns, F.inline(bound))
    joined = keyed.join(index.frame(content.sparkSession), "gate_key")
    if index.has_many_keys:
        # a rule with several literals in the row is taken once
        joined = joined.where(
            (F.size("gate_keys") == 1)
            | (F.col("gate_key") == F.element_at(F.array_intersect("keys", "gate_keys"), 1)))
    return joined.select(*columns, "ordinal", "pattern", "min_entropy")


def match_counts(content, rules, unicode=False, spread_input=True) -> DataFrame:
    """(id, ordinal, matches) per row and rule; enough for statistics and risk."""
    index = _index(rules, unicode)
    content = spread(content.select("id", "text")) if spread_input else content.select("id", "text")
    found = "regexp_extract_all(text, pattern, 0)"
    count = f"size({found})"
    if index.has_entropy:
        kept = f"filter({found}, m -> {scalars.shannon_entropy('m')} >= min_entropy)"
        count = f"if(min_entropy is null, {count}, size({kept}))"
    # in a generator, so that a pattern runs once: a filter would be moved into the join and repeat it
    some = F.filter(F.array(F.expr(count)), lambda n: n > 0)
    return candidates(content, index).select("id", "ordinal", F.explode(some).alias("matches"))


def _with_groups(hits, index):
    """Matches by the probing pattern of each rule: adds ``gaps``, ``found`` and, by group and match, ``caught`` and ``told``."""
    rows = [(r["ordinal"], *group_probe(to_java(r["match"], index.unicode))) for r in index.rules]
    probes = hits.sparkSession.createDataFrame(rows, "ordinal int, probe string, numbers array<int>, probes array<int>")
    every = "transform({}, k -> regexp_extract_all(text, probe, k))"
    return hits.join(F.broadcast(probes), "ordinal").select("*", F.explode(F.expr(
        "filter(array(regexp_extract_all(text, probe, 0)), m -> size(m) > 0)")).alias("found")).withColumns({
            "gaps": F.expr("split(text, probe, -1)"), "caught": F.expr(every.format("numbers")), "told": F.expr(every.format("probes"))})


def match_spans(content, rules, unicode=False, spread_input=True, groups=False) -> DataFrame:
    """(id, ordinal, matched, line, start_byte, end_byte), one row per match.

    With ``groups`` also ``groups``, the capturing groups of the match in order: null where a group took no part, and
    the empty string where it matched nothing.
    """
    index = _index(rules, unicode)
    keep = [c for c in content.columns if c != "text"]
    content = spread(content) if spread_input else content
    if groups:
        hits = _with_groups(candidates(content, index), index)
        placed = F.posexplode(F.expr(text.spans("gaps", "found"))).alias("at", "span")
        own = F.expr("transform(caught, (g, k) -> if(told[k][at] = '', null, g[at]))").alias("groups")
        rows = hits.select(*keep, "ordinal", "min_entropy", "caught", "told", placed).select(
            *keep, "ordinal", "min_entropy", "span.*", own)
        if index.has_entropy:
            rows = rows.where(f"min_entropy is null or {scalars.shannon_entropy('matched')} >= min_entropy")
        return rows.drop("min_entropy")
    hits = (
        candidates(content, index)
        .select("*", F.explode(F.expr("filter(array(regexp_extract_all(text, pattern, 0)), m -> size(m) > 0)")).alias("found"))
        .withColumn("gaps", F.expr("split(text, pattern, -1)"))
    )
    rows = hits.select(*keep, "ordinal", "min_entropy", F.inline(F.expr(text.spans("gaps", "found"))))
    if index.has_entropy:
        rows = rows.where(f"min_entropy is null or {scalars.shannon_entropy('matched')} >= min_entropy")
    return rows.drop("min_entropy")


def category_hits(content, rules, unicode=False) -> DataFrame:
    """(id, category) for which any rule of the category matches the row."""
    index = _index(rules, unicode)
    hit = candidates(spread(content.select("id", "text")), index).where(F.expr("text rlike pattern"))
    owner = index.metadata(content.sparkSession).select("ordinal", "category")
    return hit.select("id", "ordinal").join(F.broadcast(owner), "ordinal").select("id", "category").distinct()


def _finish(rows, metadata, kind, extra=()):
    described = rows.join(metadata, "ordinal")
    return described.select(
        "id", "rule", "category", "severity", "confidence",
        F.col("line").cast("int").alias("line"), "start_byte", "end_byte", "matched",
        F.length("matched").alias("matched_len"), "description", "reference", "tags",
        F.lit(kind).alias("kind"),
        F.expr(scalars.fingerprint("rule", "id", "line", "matched")).alias("fingerprint"),
        "ordinal", *extra,
    )


def detect(content, rules, unicode=False, per_line=False, attribution="producer", spread_input=True, groups=False) -> DataFrame:
    """All non-overlapping matches of every active rule in every row, as findings; with ``groups``, a column of that name.

    ``per_line`` lets ``^`` and ``$`` see single lines; ``attribution="first"`` names a finding
    after the first rule of its category that matches the matched text.
    """
    index = _index(rules, unicode)
    extra = [c for c in content.columns if c not in ("id", "text")]
    if per_line:
        lined = _with_lines(content, extra)
        spans = match_spans(lined, index, unicode, spread_input, groups).select(
            "id", *extra, *(["groups"] if groups else []), "ordinal", "matched", F.col("line_no").alias("line"),
            (F.col("start_byte") + F.col("line_start")).alias("start_byte"),
            (F.col("end_byte") + F.col("line_start")).alias("end_byte"))
    else:
        spans = match_spans(content, index, unicode, spread_input, groups)
    extra = [*extra, "groups"] if groups else extra
    if attribution == "first":
        spans = attribute_first(spans, index)
    elif attribution != "producer":
        raise ValueError(f"attribution is 'producer' or 'first', not {attribution!r}")
    return _finish(spans, index.metadata(content.sparkSession), "pattern", extra)


def _with_lines(content, extra):
    """One row per line with its number and start offset (running totals again)."""
    split = (content.withColumn("found", F.expr("regexp_extract_all(text, '[^\\\\n]+', 0)"))
             .withColumn("gaps", F.expr("split(text, '[^\\\\n]+', -1)")).where("size(found) > 0"))
    return split.select("id", *extra, F.inline(F.expr(text.spans("gaps", "found")))).select(
        "id", *extra, F.col("matched").alias("text"), F.col("line").alias("line_no"),
        F.col("start_byte").alias("line_start"))


def attribution_tries(matched, index) -> DataFrame:
    """(text, ordinal, pattern, ...): which rules are tried on which of the distinct matched texts.

    The matched texts go through the gate again, so only rules whose literal they hold come up.
    """
    return candidates(matched.select(F.col("matched").alias("text")).distinct(), index)


def attribute_first(spans, index) -> DataFrame:
    """Rename each match after the first rule (by ordinal) of its category that matches it.

    Each distinct matched text is looked at once, by the rules that can match it, and the result is joined back.
    In a stream, where rows cannot be gathered, the rules of the category are tried on each match.
    """
    if spans.isStreaming:
        return _attribute_rowwise(spans, index)
    spans = materialize(spans)
    owner = index.metadata(spans.sparkSession).select("ordinal", "category")
    hits = attribution_tries(spans, index).where(F.expr("text rlike pattern")).select("text", "ordinal")
    first = hits.join(F.broadcast(owner), "ordinal").groupBy("text", "category").agg(F.min("ordinal").alias("first"))
    named = spans.join(F.broadcast(owner), "ordinal").join(first.withColumnRenamed("text", "matched"), ["matched", "category"], "left")
    return named.withColumn("ordinal", F.coalesce("first", "ordinal")).select(*spans.columns)


def _attribute_rowwise(spans, index):
    spark = spans.sparkSession
    owner = {r["ordinal"]: r["category"] for r in index.rules}
    rules = spark.createDataFrame(
        [(c, [(r["ordinal"], to_java(r["match"])) for r in index.rules if r["category"] == c])
         for c in sorted(set(owner.values()))],
        "category string, peers array<struct<ordinal:int,pattern:string>>")
    categories = spark.createDataFrame(sorted(owner.items()), "ordinal int, category string")
    named = spans.join(F.broadcast(categories), "ordinal").join(F.broadcast(rules), "category")
    first = F.expr("filter(peers, p -> matched rlike p.pattern)[0].ordinal")
    return named.withColumn("ordinal", F.coalesce(first, "ordinal")).drop("category", "peers")


def capture_groups(content, rule, groups, unicode=False) -> DataFrame:
    """(id, match_index, matched, groups) of one rule; an unset group is null."""
    pattern = F.lit(to_java(rule["match"], unicode))
    columns = [F.regexp_extract_all("text", pattern, F.lit(k)) for k in range(groups + 1)]
    zipped = F.arrays_zip(*[c.alias(f"g{k}") for k, c in enumerate(columns)])
    rows = content.where(F.col("text").rlike(to_java(rule["match"], unicode))).select("id", F.posexplode(zipped).alias("match_index", "m"))
    values = [F.nullif(F.col(f"m.g{k}"), F.lit("")) for k in range(1, groups + 1)]
    return rows.select("id", "match_index", F.col("m.g0").alias("matched"), F.array(*values).alias("groups"))
