"""Clone detection over token blocks.

A file is cut into blocks of 20 tokens with a stride of 10; names, numbers and strings are
folded.  Two blocks are alike by the Jaccard similarity of their token sets, so only the
*distinct* token sets of a file are compared, and the number of block pairs follows from how
often each set occurs.  Sets are compared only when they share tokens of their prefix, which
every pair at or above the threshold does: exact, and neither a cross join nor a list of all pairs.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..session import materialize, spread

BLOCK = 20
STRIDE = 10
MIN_SIMILARITY = 0.75

# Words that keep their text when names are folded.
KEYWORDS = [
    "fn", "let", "const", "var", "if", "else", "for", "while", "return", "match", "case", "switch",
    "break", "continue", "struct", "enum", "impl", "trait", "pub", "mod", "use", "import", "package",
    "func", "def", "class", "async", "await", "yield", "try", "catch", "throw", "throws", "finally",
    "new", "delete", "typeof", "instanceof",
]

WORD = r"[\p{L}_][\p{L}\p{N}_]*"
NUMBER = r"\p{N}[\p{N}.xA-Fa-f]*"
OTHER = r"[^\s\p{Z}]"


def _quoted(q, possessive):
    plus, star = ("++", "*+") if possessive else ("", "*")
    return rf"{q}(?:[^{q}\\]{plus}|\\[\s\S]){star}(?:{q}|\\?\z)"


def token_pattern(possessive=True):
    """One alternation for all tokens; possessive loops keep long strings off the Java stack."""
    return "|".join((WORD, NUMBER, _quoted('"', possessive), _quoted("'", possessive), OTHER))


def _folded(t):
    """Kind of a token by its first character; a pattern is only asked beyond ASCII."""
    keywords = ", ".join(f"'{k}'" for k in KEYWORDS)
    return (f"case when {t} in ({keywords}) then {t} "
            f"when ascii({t}) between 97 and 122 or ascii({t}) between 65 and 90 or ascii({t}) = 95 then 'ID' "
            f"when ascii({t}) between 48 and 57 then 'NUM' when ascii({t}) in (34, 39) then 'STR' "
            f"when ascii({t}) < 128 then {t} when {t} rlike '^\\\\p{{L}}' then 'ID' "
            f"when {t} rlike '^\\\\p{{N}}' then 'NUM' else {t} end")


def _cut(with_lines):
    """SQL of the blocks of a file in order, as an array of (line, end, part)."""
    first, last = ("lines[i]", f"lines[i + {BLOCK - 1}]") if with_lines else ("0", "0")
    return (f"if(size(tokens) > {BLOCK}, transform(sequence(0, size(tokens) - {BLOCK} - 1, {STRIDE}), i -> named_struct("
            f"'line', {first}, 'end', {last}, 'part', slice(tokens, i + 1, {BLOCK}))), array())")


def _tokens(files, min_tokens, with_lines):
    """(id, tokens, lines): the folded tokens of each file in order, and the lines they begin at.

    Folded tokens hold no white space, so with line breaks among them they are one text again, and its lines are those
    of the tokens: no running total over them.  A string's own line breaks come after it.
    """
    files = spread(files.select("id", "text").where("id is not null and text is not null"))
    files = files if min_tokens <= BLOCK else files.where("false")
    pattern = token_pattern()
    if not with_lines:
        found = files.select("id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))
        return found.select("id", F.expr(f"transform(found, t -> {_folded('t')})").alias("tokens"), F.lit(None).cast("array<int>").alias("lines"))
    found = files.select("id", F.regexp_extract_all("text", F.lit(pattern + r"|\n"), F.lit(0)).alias("found"))
    broken = f"if(ascii(t) in (34, 39) and contains(t, '\\n'), concat('STR', repeat('\\n', {text.newlines('t')})), {_folded('t')})"
    marked = f"array_join(transform(found, t -> {broken}), ' ')"
    rows = found.select("id", F.expr(f"transform(split({marked}, '\\n', -1), l -> regexp_extract_all(l, '[^ ]+', 0))").alias("rows"))
    return rows.select("id", F.expr("flatten(rows)").alias("tokens"),
                       F.expr("flatten(transform(rows, (r, i) -> array_repeat(i + 1, size(r))))").alias("lines"))


def blocks(files, min_tokens=BLOCK, with_lines=True) -> DataFrame:
    """(id, block, line, end, normalized, token_set) of every block; lines are those of its first and last token."""
    token_set = F.coalesce(F.sort_array(F.array_distinct("b.part")), F.array().cast("array<string>"))
    # a file without a block yields no row; a filter here would run the tokenizer a second time
    return _tokens(files, min_tokens, with_lines).select("id", F.posexplode(F.expr(_cut(with_lines))).alias("block", "b")).select(
        "id", "block", "b.line", "b.end", F.array_join("b.part", " ").alias("normalized"), token_set.alias("token_set"))


# Fixed value: tokens that most blocks hold; they come last, so that they seldom fall into a prefix.
COMMON = ["{", "}", "[", "]", ":", "=", '"', "-", ";", "(", ")", "STR", "NUM", ".", ",", "ID"]


def let(value, name, body):
    """An SQL expression with a value computed once and bound to a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _runs(array, key):
    """Array of runs (arrays) of a sorted array whose elements agree in ``key`` of ``x``."""
    same = key.format("a[i]"), key.format("a[i - 1]")
    starts = f"filter(sequence(0, size(a) - 1), i -> i = 0 or {same[0]} <> {same[1]})"
    runs = "transform(starts, (s, k) -> slice(a, s + 1, coalesce(get(starts, k + 1), size(a)) - s))"
    return let(array, "a", f"if(size(a) = 0, slice(array(a), 1, 0), {let(starts, 'starts', runs)})")


def _prefix(ordered, threshold):
    """The tokens of which two similar sets share at least one."""
    return f"slice({ordered}, 1, size({ordered}) - cast(ceil({threshold} * size({ordered}) - 1e-9) as int) + 1)"


def clone_pairs(files, min_similarity=MIN_SIMILARITY, min_tokens=BLOCK, with_lines=True) -> DataFrame:
    """Similar blocks of each file, one row per pair of token sets.

    ``blocks1`` and ``blocks2`` list (block, line, end); equal sets have one row with ``blocks2`` null.
    ``pairs`` is the number of block pairs the row stands for, ``token_count`` the block size;
    ``clone_locations`` lists the pairs.

    A file is paired inside its row: blocks are sorted by token set, runs of equal sets numbered, and an
    inverted index from prefix tokens to set numbers says which sets are compared.  Nothing is shuffled.
    """
    common = "array(" + ", ".join(f"'{c}'" for c in COMMON) + ")"
    block = ("named_struct('s', sort_array(array_distinct(b.part)), 'at', "
             "named_struct('block', i, 'line', b.line, 'end', b.end))")
    # sets: (o, at): tokens, rarest kinds first, and the blocks that have them
    sets = (f"transform({_runs(f'sort_array(transform(bs, (b, i) -> {block}))', '{}.s')}, r -> named_struct("
            f"'o', concat(array_except(r[0].s, {common}), array_intersect({common}, r[0].s)), 'at', transform(r, x -> x.at)))")
    entries = f"sort_array(flatten(transform(sets, (v, i) -> transform({_prefix('v.o', min_similarity)}, t -> named_struct('t', t, 'i', i)))))"
    index = let(_runs(entries, "{}.t"), "rs", "map_from_arrays(transform(rs, r -> r[0].t), transform(rs, r -> transform(r, e -> e.i)))")
    shared = "size(array_intersect(v.o, sets[j].o))"
    similarity = let(shared, "n", "n / cast(size(v.o) + size(sets[j].o) - n as double)")
    met = f"filter(array_distinct(flatten(transform({_prefix('v.o', min_similarity)}, t -> index[t]))), j -> j > i)"
    near = (f"flatten(transform(sets, (v, i) -> filter(transform({met}, j -> named_struct('blocks1', v.at, 'blocks2', sets[j].at, "
            f"'similarity', {similarity})), p -> p.similarity >= {min_similarity})))")
    same = ("transform(filter(sets, v -> size(v.at) > 1), v -> named_struct('blocks1', v.at, 'blocks2', "
            "cast(null as array<struct<block:int,line:int,end:int>>), 'similarity', cast(1 as double)))")
    rows = _tokens(files, min_tokens, with_lines).select("id", F.expr(_cut(with_lines)).alias("bs")).select("id", F.expr(sets).alias("sets"))
    rows = rows.select("id", F.inline(F.expr(f"concat({same}, {let(index, 'index', near)})")))
    pairs = "if(blocks2 is null, cast(size(blocks1) as bigint) * (size(blocks1) - 1) div 2, cast(size(blocks1) as bigint) * size(blocks2))"
    return rows.withColumns({"pairs": F.expr(pairs), "clone_type": F.expr(scalars.clone_type("similarity")),
                             "token_count": F.lit(BLOCK)})


def clone_locations(pairs) -> DataFrame:
    """(id, block1, line1, end1, block2, line2, end2, similarity, clone_type) of every pair of blocks, earlier block first.

    There are as many rows as block pairs, as many as the square of a file's equal blocks.
    """
    first = pairs.select("id", "similarity", "clone_type", "blocks1", "blocks2", F.posexplode("blocks1").alias("i", "x"))
    # of equal sets each pair once
    other = F.expr("if(blocks2 is null, slice(blocks1, i + 2, size(blocks1)), blocks2)")
    both = first.select("id", "similarity", "clone_type", "x", F.explode(other).alias("y"))
    swap = F.col("x.block") > F.col("y.block")
    one, two = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    return both.select("id", one.alias("one"), two.alias("two"), "similarity", "clone_type").select(
        "id", *[F.col(f"{side}.{c}").alias(f"{c}{k}") for k, side in ((1, "one"), (2, "two")) for c in ("block", "line", "end")],
        "similarity", "clone_type")


def clone_findings(pairs) -> DataFrame:
    """Findings of kind ``clone``: one per row of ``clone_pairs``, at its first block."""
    at = F.col("blocks1")[0]
    matched = F.concat_ws("~", at["block"].cast("string"), F.coalesce(F.col("blocks2")[0]["block"], F.col("blocks1")[1]["block"]).cast("string"))
    rows = pairs.select("id", F.lit("code-clone").alias("rule"), F.lit("code").alias("category"),
                        F.lit("low").alias("severity"), F.lit("medium").alias("confidence"),
                        at["line"].alias("line"), matched.alias("matched"),
                        F.expr(scalars.clone_type_description("clone_type")).alias("description"),
                        F.lit("clone").alias("kind"))
    return rows.withColumn("fingerprint", F.expr(scalars.fingerprint("rule", "id", "line", "matched")))


def clone_groups_across(files, min_tokens=BLOCK) -> DataFrame:
    """Equal normalized blocks over the whole table: one row per block text held more than once."""
    return blocks(files, min_tokens, with_lines=False).groupBy("normalized").agg(
        F.count("*").alias("blocks"), F.countDistinct("id").alias("files"), F.min("id").alias("first_id")).where("blocks > 1")


# A key that more sets share is dealt over blocks of about so many.
HOT_SETS = 1024


def _banded(size, threshold):
    """SQL of the number of the band of a set size: sets that are similar lie in one band or in neighbours."""
    lows, low = [], 1
    while low <= BLOCK:
        lows.append(low)
        low = int(low / threshold + 1e-9) + 1
    return " + ".join(f"if({size} >= {x}, 1, 0)" for x in lows)


def near_candidates(sets, threshold=MIN_SIMILARITY, hot=HOT_SETS) -> DataFrame:
    """(x, y, band, a, b): pairs of sets (id, o, ...) that meet at a key, kept only if similar; each pair once.

    ``o`` holds the tokens by measured frequency, rarest first.  Two different sets above a threshold of one half
    have two tokens in common among their first ``n - ceil(threshold n) + 2``, so the key is two tokens and a band
    of sizes; a set takes part in its band and in the next.  A key of more than ``hot`` sets is dealt over pairs of
    blocks of them.  The join itself compares, so pairs that are not similar do not leave it.
    """
    prefix = f"slice(o, 1, size(o) - cast(ceil({threshold} * size(o) - 1e-9) as int) + 2)"
    keys = let(prefix, "p", "flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> named_struct('a', a, 'b', b))))")
    keyed = sets.select("id", "o", F.explode(F.expr(f"array({_banded('size(o)', threshold)}, {_banded('size(o)', threshold)} + 1)")).alias("band"),
                        F.expr(keys).alias("keys")).select("id", "o", "band", F.inline("keys"))
    crowd = keyed.groupBy("band", "a", "b").agg(F.count("*").alias("crowd")).where("crowd > 1")
    blocks_of = F.expr(f"cast(ceil(crowd / {hot}) as int)")
    dealt = keyed.join(crowd, ["band", "a", "b"]).withColumn("n", blocks_of).withColumn("own", F.expr("pmod(xxhash64(id), n)"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("with")).select(
        "id", "o", "band", "a", "b", "own", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))
    x, y = dealt.alias("x"), dealt.alias("y")
    shared = "size(array_intersect(x.o, y.o))"
    # a pair meets in the band of the larger set; of the keys it shares the first counts
    larger = _banded("greatest(size(x.o), size(y.o))", threshold)
    first = "array_intersect(x.o, y.o)[0] = x.a and array_intersect(x.o, y.o)[1] = x.b"
    meet = ("x.band = y.band and x.a = y.a and x.b = y.b and x.low = y.low and x.high = y.high and x.id < y.id "
            "and (x.low = x.high or x.own <> y.own)")
    fits = (f"least(size(x.o), size(y.o)) >= {threshold} * greatest(size(x.o), size(y.o)) - 1e-9 and x.band = {larger} and {first} "
            f"and {shared} >= {threshold} * (size(x.o) + size(y.o) - {shared}) - 1e-9")
    return x.join(y, F.expr(f"{meet} and {fits}")).select(
        F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.expr(f"{shared} / cast(size(x.o) + size(y.o) - {shared} as double)").alias("similarity"))


def near_clones_across(files, min_similarity=MIN_SIMILARITY, min_tokens=BLOCK) -> DataFrame:
    """Similar token sets over the whole table, with the number of blocks on each side.

    Only distinct token sets are compared, so copies of a file do not add pairs.  The tokens of a set are ordered by
    how many sets hold them.  The threshold is above one half.
    """
    if min_similarity <= 0.5:
        raise ValueError("near clones need a similarity above 0.5")
    sets = blocks(files, min_tokens, with_lines=False).groupBy("token_set").agg(F.count("*").alias("blocks"))
    # written, as the numbers have to be the same wherever they are read
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()))
    # as many rows as kinds of tokens: keywords and single characters
    held = sets.select("id", F.explode("token_set").alias("token"))
    frequency = held.groupBy("token").agg(F.count("*").alias("sets"))
    ordered = held.join(frequency, "token").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sets", "token"))), lambda t: t.token).alias("o"))
    pairs = near_candidates(materialize(ordered), min_similarity)
    side = lambda k, name: sets.select(F.col("id").alias(name), F.col("token_set").alias(f"set{k}"), F.col("blocks").alias(f"blocks{k}"))
    told = pairs.join(side(1, "x"), "x").join(side(2, "y"), "y")
    swap = F.col("set1") > F.col("set2")
    pick = lambda name, k: F.when(swap, F.col(f"{name}{3 - k}")).otherwise(F.col(f"{name}{k}")).alias(f"{name}{k}")
    return told.select(pick("set", 1), pick("set", 2), pick("blocks", 1), pick("blocks", 2), "similarity",
                       F.expr(scalars.clone_type("similarity")).alias("clone_type"))
