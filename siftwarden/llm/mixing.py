"""Mixing sources to target weights, by thresholds on a hash that histograms find.

A source's target is its weight's share of all words, but at most ``cap`` times its size; what is cut off
goes to the others by weight.  Documents are ordered by a hash of id and text, and a source takes its
documents below a threshold, on top of whole rounds of all of them.  The threshold is the place where the
words so far reach the budget: words are summed by bucket of hash values, the bucket in which the budget
ends is cut into buckets again, until it holds a single row.  No row is sorted.  Budgets are nested: a
larger one takes every word that a smaller one takes.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stored

WHITE = "\\x20\\x09-\\x0D"
BUCKETS = 4096


def word_count(text):
    """Number of runs of what is not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def place_of(id_col, text_col):
    """A number below 2^60 from a row's id and text (null: empty)."""
    told = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources, weights=(5, 2, 1), cap=3, share=1.0):
    """``sources(source, source_size)`` with ``target``, in words.

    Sources in order of their names, null last, get the weights in turn.  With ``level`` the words a weight
    of one gets, a target is the smaller of weight times level and cap times size; the sources that reach
    their cap are those of least cap a weight, so the level follows from running sums over one row a source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                     ((F.row_number().over(named) - 1) % len(weights) + 1)))
    rows = rows.withColumns({"most": F.col("source_size") * F.lit(float(cap)),
                             "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumns({"level": level, "turn": F.row_number().over(filled)})
    first = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("turn"))).over(Window.partitionBy())
    # a share beyond the cap of all sources leaves no level: every source is at its cap
    return rows.withColumn("level", first).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("level"), "most")).alias("target"))


def limits(sized, aims):
    """Where each source's budget ends: (source, rounds, tied, place, lo, hi, left).

    ``rounds`` times all documents are taken.  Then, with ``tied`` false, documents at places below ``lo``, and
    ``left`` words of the one at ``lo``.  With ``tied`` true rows of one place stand at the limit: rows below
    ``place``, those at ``place`` with a row number below ``lo``, and ``left`` words of the one at ``lo``.
    """
    ends = sized.groupBy("source").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("row").alias("row_lo"),
                                       F.max("row").alias("row_hi"), F.count(F.lit(1)).alias("rows"))
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    state = aims.alias("t").join(ends.alias("e"), F.expr("t.source <=> e.source")).select(
        "t.source", rounds.alias("rounds"), F.lit(False).alias("tied"), F.lit(None).cast("long").alias("place"), "lo", "hi",
        "row_lo", "row_hi", "rows", (budget - rounds * F.col("source_size")).alias("left"))

    def tie(state):
        """Rows that share one place are told apart by their row numbers from here on."""
        now = ~F.col("tied") & (F.col("lo") == F.col("hi")) & (F.col("rows") > 1)
        return state.select("source", "rounds", (F.col("tied") | now).alias("tied"),
                            F.when(now, F.col("lo")).otherwise(F.col("place")).alias("place"),
                            F.when(now, F.col("row_lo")).otherwise(F.col("lo")).alias("lo"),
                            F.when(now, F.col("row_hi")).otherwise(F.col("hi")).alias("hi"), "rows", "left")

    state, done = stored(tie(state), "limits"), None
    while True:
        ready = state.filter("left = 0 or rows = 1")
        done = ready if done is None else done.unionAll(ready)
        open_ = state.filter("left > 0 and rows > 1")
        if open_.isEmpty():
            return done
        value = F.expr("if(s.tied, r.row, r.place)")
        inside = sized.alias("r").join(open_.alias("s"), F.expr(
            "r.source <=> s.source and if(s.tied, r.place = s.place and r.row between s.lo and s.hi, r.place between s.lo and s.hi)"))
        bucket = F.expr(f"(value - lo) div ((hi - lo) div {BUCKETS} + 1)")
        inside = inside.select("s.source", value.alias("value"), "r.row", "r.size", "s.lo", "s.hi").withColumn("bucket", bucket)
        counts = inside.groupBy("source", "bucket").agg(
            F.sum("size").alias("words"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.count(F.lit(1)).alias("rows"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        counts = counts.withColumn("before", running - F.col("words"))
        state = open_.alias("s").join(counts.alias("c"), F.expr(
            "s.source <=> c.source and c.before <= s.left and s.left < c.before + c.words")).select(
            "s.source", "s.rounds", "s.tied", "s.place", "c.lo", "c.hi", "c.row_lo", "c.row_hi", "c.rows",
            (F.col("s.left") - F.col("c.before")).alias("left"))
        state = stored(tie(state), "limits")


def mix_sources(docs, weights=(5, 2, 1), cap=3, share=1.0, id_col="doc_id", text_col="text", source_col="source", keep=()):
    """(id, kept columns, ``size``, ``source_size``, ``target``, ``taken``), one row per document.

    ``size`` counts the words of the text, ``source_size`` those of its source, ``target`` what the source should
    give of ``share`` times all words, ``taken`` the words that the mix takes of the document, repeats counted.
    A source's taken words add up to its target, rounded down: whole documents, but for the one at the limit,
    which gives its first words.  No document gives more than ``cap`` times its size.  Null and empty texts have no
    words; a null source is one source, the last.  Repeated rows count each; which of several equal rows is
    taken is not told, but how many is.  Other columns are ignored, unless kept; an empty table gives no rows.
    """
    names = [f"kept{i}" for i in range(len(keep))]
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
                        place_of(id_col, text_col).alias("place"), F.monotonically_increasing_id().alias("row"),
                        *[F.col(c).alias(n) for c, n in zip(keep, names)])
    sized = stored(sized, "sized")
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aims = stored(targets(sums, weights, cap, share), "targets")
    ends = limits(sized, aims)
    small = aims.alias("t").join(ends.alias("l"), F.expr("t.source <=> l.source")).select(
        "t.source", "source_size", "target", "rounds", "tied", F.col("place").alias("at"), "lo", "left")
    small = stored(small, "mix")
    below = "if(tied, place < at or (place = at and row < lo), place < lo)"
    border = "if(tied, place = at and row = lo, place = lo)"
    taken = F.expr(f"rounds * size + case when {below} then size when {border} then least(left, size) else 0 end")
    return sized.alias("r").join(small.alias("s"), F.expr("r.source <=> s.source")).select(
        F.col("id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(keep, names)], "size", "source_size", "target",
        taken.alias("taken"))
