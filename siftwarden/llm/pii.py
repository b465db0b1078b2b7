"""Personal data: pattern spans, and terms that give protected values away by how they occur with them.

A protected value (an address, a number) carries ``-log(df / N)`` of information.  A term in the same
documents, at any distance, discloses ``log(both * N / (df_value * df_term))`` of that; all three are
numbers of documents.  Where the share reaches a threshold the term is generalised in all documents that
hold the value, and above a higher one it is removed, as otherwise it would still point to what was
taken out.  Terms are words of three letters or more.

One text is no estimate: every word that stands only there would disclose all of any value in it.  So a share counts
if the term and the value meet in two different texts, or if the term stands within ``NEAR_WORDS`` words of the value
in one.
"""

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField, StructType)

from .common import slices, stored

KINDS = ("email", "ip", "card", "phone")
LEAST_LENGTH = 3
NEAR_WORDS = 6
GENERALISE, REMOVE = 0.9, 0.97
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs and the look-behind find the same matches without trying a run again from its middle
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
NOT_DIGIT = re.compile(r"[^0-9]")
SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                             StructField("end", LongType()), StructField("action", StringType())]))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text):
    """Matches of local part, @ and dotted domain, from the left without overlap; linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            # what lies before this @ can be no part of a later local part
            end, at = at + 1, text.find("@", at + 1)


def base_spans(text):
    """(kind, start, end) of all pattern matches, by start, then by kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in NUMBER.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def held(text, spans):
    """The protected values of a text, its words outside them, and the (value, word) pairs that stand near each other."""
    covered = sorted((a, b) for _, a, b in spans)
    words, i = [], 0
    for m in WORD.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if len(m[0]) >= LEAST_LENGTH and (i == len(covered) or m.end() <= covered[i][0]):
            words.append((m.start(), m.end(), m[0].lower()))
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    values, near = set(), set()
    for kind, a, b in spans:
        value = f"{kind}:{text[a:b].lower() if kind in ('email', 'ip') else NOT_DIGIT.sub('', text[a:b])}"
        values.add(value)
        before, behind = bisect_right(ends, a), bisect_left(starts, b)
        for _, _, word in (*words[max(0, before - NEAR_WORDS):before], *words[behind:behind + NEAR_WORDS]):
            near.add((value, word))
    return values, {w for _, _, w in words}, near


def held_of(batches):
    """Values, terms and near pairs of each document that has values."""
    for part in slices(batches, 2):
        keys, prints, found = [], [], ([], [], [])
        for key, own, text in zip(*(part.column(i).to_pylist() for i in range(3))):
            if spans := base_spans(text):
                keys.append(key)
                prints.append(own)
                for out, rows in zip(found, held(text, spans)):
                    out.append(sorted(rows))
        kind = pa.list_(pa.string())
        pairs = pa.list_(pa.struct([("value", pa.string()), ("term", pa.string())]))
        near = [[{"value": v, "term": t} for v, t in rows] for rows in found[2]]
        yield pa.record_batch({"key": pa.array(keys, pa.int64()), "print": pa.array(prints, pa.int64()), "values": pa.array(found[0], kind),
                               "terms": pa.array(found[1], kind), "near": pa.array(near, pairs)})


def terms_of(batches):
    """Documents of each batch that hold a term."""
    for batch in batches:
        counts = Counter()
        for part in slices([batch], 0):
            for text in part.column(0).to_pylist():
                counts.update({w for w in WORD.findall(text.lower()) if len(w) >= LEAST_LENGTH})
        yield pa.record_batch({"term": pa.array(list(counts), pa.string()),
                               "n": pa.array(list(counts.values()), pa.int64())})


def cleaned(text, spans):
    """The text with each stretch of overlapping spans replaced; removed terms leave nothing."""
    out, at = [], 0
    for kind, a, b, action in spans:
        if a >= at:
            out.append(text[at:a])
            out.append("" if action == "remove" else f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs, id_col="doc_id", text_col="text", generalise=GENERALISE, remove=REMOVE):
    """The input's columns with ``spans`` (kind, start, end in code points, action) and ``clean_text``.

    Kinds are email, ip, card, phone and term.  Spans are by start, then by kind in this order; pattern
    spans are always replaced.  A null text has no spans and stays null.  Statistics are over all
    documents; repeated rows count each.  Columns of the input named ``spans`` or ``clean_text`` are
    replaced.  Texts without a digit and an @ can hold no value and are not looked into further.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("spans", "clean_text")])
    kept = docs.columns
    docs = docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("string"), text_col))
    may = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    rows = docs.filter(may)

    texts = rows.select("__key", F.xxhash64(text_col), text_col).mapInArrow(
        held_of, "key bigint, print bigint, values array<string>, terms array<string>, near array<struct<value:string,term:string>>")
    # rows of one key have one text
    texts = stored(texts.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("print", "values", "terms", "near")],
                                            F.count(F.lit(1)).alias("n")), "held")
    total = float(docs.count())
    values = texts.select("key", "print", "n", F.explode("values").alias("value"))
    counts = values.groupBy("value").agg(F.sum("n").alias("df_value"), (F.min("print") < F.max("print")).alias("several")).filter(
        F.col("df_value") < total)
    # no term of more documents can reach the share, as it cannot be with the value in more than its own
    counts = stored(counts.withColumn("most", F.pow("df_value", F.lit(generalise)) * total ** (1 - generalise) * (1 + 1e-9)), "values")
    most = counts.agg(F.max("most")).first()[0] or 0.0
    terms = (docs.select(F.coalesce(text_col, F.lit(""))).mapInArrow(terms_of, "term string, n bigint")
             .groupBy("term").agg(F.sum("n").alias("df_term")).filter(F.col("df_term") <= most))
    terms = stored(texts.select("key", F.explode("terms").alias("term")).join(terms, "term"), "terms")
    near = texts.select("key", F.inline("near"))
    disclosed = F.log(F.col("both") * total / (F.col("df_value") * F.col("df_term")))
    share = (disclosed / F.log(F.lit(total) / F.col("df_value"))).alias("share")

    # a value of one text meets a term in all its documents; only what stands near it counts
    single = near.join(counts.filter("not several"), "value").join(terms, ["key", "term"]).withColumn("both", F.col("df_value"))
    single = single.select("key", "term", share)
    # other values meet all rare terms of their documents
    pairs = stored(values.join(counts.filter("several"), "value").join(terms, "key").filter("df_term <= most").select(
        "key", "print", "n", "value", "term", "df_value", "df_term"), "pairs")
    both = pairs.groupBy("value", "term", "df_value", "df_term").agg(F.sum("n").alias("both"), (F.min("print") < F.max("print")).alias("met"))
    telling = both.select("value", "term", "met", share).filter(F.col("share") >= generalise)
    beside = near.join(counts.filter("several").select("value"), "value").select("value", "term").distinct()
    telling = telling.filter("met").unionByName(telling.filter("not met").join(beside, ["value", "term"], "left_semi")).select("value", "term", "share")
    told = pairs.join(telling, ["value", "term"]).select("key", "term", "share").unionAll(single.filter(F.col("share") >= generalise))
    told = told.groupBy("key", "term").agg(F.max("share").alias("share"))
    told = told.groupBy("key").agg(F.collect_list(F.struct(
        "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action"))).alias("__told"))

    def run(batches):
        at = kept.index(text_col)
        for part in slices(batches, at):
            found, texts = [], []
            for text, told in zip(part.column(at).to_pylist(), part.column(len(kept)).to_pylist()):
                spans = [(k, a, b, "replace") for k, a, b in base_spans(text)]
                if told:
                    action = {t["term"]: t["action"] for t in told}
                    taken = {i for _, a, b, _ in spans for i in range(a, b)}
                    spans += [("term", *m.span(), action[m[0].lower()]) for m in WORD.finditer(text)
                              if m[0].lower() in action and m.start() not in taken]
                    spans.sort(key=lambda s: (s[1], (*KINDS, "term").index(s[0])))
                found.append([dict(zip(("kind", "start", "end", "action"), s)) for s in spans])
                texts.append(cleaned(text, spans))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                       ("action", pa.string())]))
            columns = [*part.columns[:len(kept)], pa.array(found, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "spans", "clean_text"])

    schema = StructType([*docs.select(*kept).schema.fields, StructField("spans", SPAN),
                         StructField("clean_text", StringType())])
    looked = rows.join(told.withColumnRenamed("key", "__key").hint("shuffle_hash"), "__key", "left").select(
        *kept, "__told").mapInArrow(run, schema)
    plain = docs.filter(~may).select(*kept, F.lit(None).cast(SPAN).alias("spans"), F.col(text_col).alias("clean_text"))
    return looked.unionAll(plain.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN))))
