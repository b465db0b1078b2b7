"""Text expressions as SQL templates over a column or expression name."""

from pyspark.sql import functions as F

LINE_BREAK = "\\\\r?\\\\n"

# Offsets are summed in chunks, so a row with very many matches stays near linear.
CHUNK = 256


def lines(x):
    """Lines as an array: both line ends count, a last empty line does not."""
    parts = f"split({x}, '{LINE_BREAK}', -1)"
    return (f"transform(array({parts}), a -> if(element_at(a, -1) = '', "
            f"slice(a, 1, size(a) - 1), a))[0]")


def line_count(x):
    return (f"(length({x}) - length(replace({x}, '\\n', '')) + "
            f"if({x} = '' or endswith({x}, '\\n'), 0, 1))")


def newlines(x):
    return f"(length({x}) - length(replace({x}, '\\n', '')))"


def occurrences(x, part):
    """Non-overlapping count of a fixed string."""
    return f"((length({x}) - length(replace({x}, '{part}', ''))) div {len(part)})"


def trimmed(x):
    return f"regexp_replace({x}, '^\\\\s+|\\\\s+$', '')"


def spans(gaps, matches):
    """Array of (matched, line, start_byte, end_byte) from the gaps around the matches.

    Both the byte offset and the line of a match are running totals over what lies before it:
    first per chunk, then the chunk bases, then inside the chunks.
    """
    steps = (f"transform({matches}, (m, i) -> struct("
             f"cast(octet_length({gaps}[i]) as bigint) as gb, cast({newlines(f'{gaps}[i]')} as bigint) as gn, "
             f"cast(octet_length(m) as bigint) as mb, cast({newlines('m')} as bigint) as mn, m as matched))")
    chunks = (f"transform(array({steps}), s -> transform(sequence(0, size(s) - 1, {CHUNK}), "
              f"k -> slice(s, k + 1, {CHUNK})))[0]")
    total = ("aggregate(c, struct(0L as b, 0L as n), (t, e) -> "
             "struct(t.b + e.gb + e.mb as b, t.n + e.gn + e.mn as n))")
    bases = ("aggregate(cs, struct(0L as b, 0L as n, cast(array() as array<struct<b:bigint,n:bigint>>) as seen), "
             f"(acc, c) -> transform(array({total}), t -> struct(acc.b + t.b as b, acc.n + t.n as n, "
             "array_append(acc.seen, struct(acc.b as b, acc.n as n)) as seen))[0]).seen")
    inner = ("aggregate(c, struct(bs[ci].b as b, bs[ci].n as n, "
             "cast(array() as array<struct<matched:string,line:bigint,start_byte:bigint,end_byte:bigint>>) as seen), "
             "(acc, e) -> struct(acc.b + e.gb + e.mb as b, acc.n + e.gn + e.mn as n, "
             "array_append(acc.seen, struct(e.matched as matched, acc.n + e.gn + 1 as line, "
             "acc.b + e.gb as start_byte, acc.b + e.gb + e.mb as end_byte)) as seen)).seen")
    return (f"flatten(flatten(transform(array({chunks}), cs -> transform(array({bases}), bs -> "
            f"flatten(transform(cs, (c, ci) -> {inner}))))))")


def line_rows(df, text="text"):
    """One row per line: adds ``line`` (1-based) and ``line_text``."""
    return df.select("*", F.posexplode(F.expr(lines(text))).alias("pos", "line_text")).select(
        *df.columns, (F.col("pos") + 1).alias("line"), "line_text")
