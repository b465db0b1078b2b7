"""Chat formatting with a grammar round trip: what is rendered must parse back to the same turns.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Neither a role nor a text may hold a control string, and a role no line break.  A turn is rendered
plainly first and parsed again; where that does not give the turn back, its content is escaped: every
``<``, backslashes, optional ``n``, ``|`` gets one more backslash, and a line break in a role becomes
``<n|``.  The parser always takes one backslash away, so a plain turn that looks escaped is a conflict
as well.  All of it is DataFrame functions.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text):
    return F.regexp_replace(text, r"<(\\*)(n?)\|", r"<$1\\$2|")


def unescape(text):
    return F.regexp_replace(text, r"<\\(\\*)(n?)\|", r"<$1$2|")


def escape_role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("<n|"))


def unescape_role(role):
    return unescape(F.replace(role, F.lit("<n|"), F.lit("\n")))


def piece(role, text):
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted):
    """Array of (role, text) of a rendered conversation; null where it does not follow the grammar."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    body = F.transform(turns, lambda t: F.substr(t, F.lit(len(START) + 1)))
    well = F.forall(turns, lambda t: F.startswith(t, F.lit(START)) & F.contains(t, F.lit("\n"))) & ~F.exists(
        body, lambda t: F.contains(t, F.lit(START)) | F.contains(t, F.lit(END))) & (F.element_at(parts, -1) == "")

    def turn(t):
        role = F.substring_index(t, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(t, F.length(role) + 2)).alias("text"))

    return F.when(well, F.transform(body, turn))


def render(turns, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", learn_role="assistant"):
    """One row per conversation: id, ``formatted``, ``turns`` as parsed back, and ``loss_spans``.

    A loss span (start, end in code points of ``formatted``) covers one text of ``learn_role``; its
    control strings are outside.  Turns are ordered by turn, ties by role and text; null roles and texts
    are empty, null turns come first, rows without a conversation id are one conversation, repeated rows
    are turns each.  Fails if a conversation does not parse back to its source.  Other columns are
    ignored.  A conversation is one value of the result, so its turns meet in one task.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = parse(piece(F.col("role"), F.col("text")))
    same = F.coalesce((F.size(plain) == 1) & (plain[0].role == F.col("role")) & (plain[0].text == F.col("text")), F.lit(False))
    rows = rows.withColumn("same", same)
    rows = rows.withColumns({
        "role_out": F.when(F.col("same"), F.col("role")).otherwise(escape_role(F.col("role"))),
        "text_out": F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text")))})
    rows = rows.withColumn("piece", piece(F.col("role_out"), F.col("text_out")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    start = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")
    first = F.col("start") + len(START) + F.length("role_out") + 1
    rows = rows.withColumns({"at": F.row_number().over(order), "start": start}).withColumn(
        "loss", F.when(F.col("role") == learn_role, F.struct(first.alias("start"), (first + F.length("text_out")).alias("end"))))
    kept = F.sort_array(F.collect_list(F.struct("at", "piece", "loss", "role", "text")))
    whole = rows.groupBy("conv").agg(kept.alias("rows")).select(
        "conv", F.array_join(F.transform("rows", lambda r: r.piece), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("source"),
        F.filter(F.transform("rows", lambda r: r.loss), lambda s: s.isNotNull()).alias("loss_spans"))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation does not parse back to its turns")))
    return whole.select(F.col("conv").alias(conv_col), "formatted", checked.alias("turns"), "loss_spans")


def loss_texts(formatted="formatted", spans="loss_spans"):
    """The texts under the loss mask, read from the rendered conversation and unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s.start.cast("int") + 1, (s.end - s.start).cast("int"))))
