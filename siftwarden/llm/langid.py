"""Language identification by rank-order profiles.

A profile is a list of n-grams (1 to 5 characters, inside words padded by ``_``) from most to least
frequent, ties by code.  A document gets the language whose profile is least out of place: the sum, over the
document's n-grams, of how far their ranks differ; an n-gram that a profile lacks counts as its length.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import mix, slices, stored
from .fingerprints import A

LONGEST = 5
PROFILE = 400
SAMPLE_DOCS = 2000
BROADCAST_LABELS = 10_000
CHUNK_WORDS = 50_000
FOLDS = 4
LOW, SHARE, STEPS = 0.05, 2 / 3, 10_000
WORD = re.compile(r"[^\W\d_]+")


def letters_of(text):
    """The words of a text, lower-cased, of letters alone: ``[^\\W\\d_]`` also has numbers such as one half."""
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in WORD.findall(text.lower())
            if w.isalpha() or any(map(str.isalpha, w))]


def gram_counts(words):
    """(codes, counts) of the 1- to 5-grams of a list of words, each padded by ``_`` on either side."""
    parts = []
    for at in range(0, len(words), CHUNK_WORDS):
        letters = np.frombuffer(f"_{'_'.join(words[at:at + CHUNK_WORDS])}_".encode("utf-32-le"), np.uint32).astype(np.uint64)
        pads = np.concatenate([[0], np.cumsum(letters == ord("_"))])
        code, found = np.zeros(len(letters), dtype=np.uint64), []
        for n in range(1, LONGEST + 1):
            size = len(letters) - n + 1
            if size < 1:
                break
            code = mix(code[:size] * A + letters[n - 1:] + np.uint64(1))
            # a pad may only be the first or the last character
            inside = pads[n - 1:n - 1 + size] - pads[1:1 + size] if n > 2 else np.zeros(size, dtype=np.int64)
            found.append(code[(inside == 0) & (letters[:size] != ord("_"))] if n == 1 else code[inside == 0])
        parts.append(np.unique(np.concatenate(found), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def code_of(gram):
    """The code of one n-gram, pads included."""
    code = np.zeros(1, dtype=np.uint64)
    for letter in gram:
        code = mix(code * A + np.uint64(ord(letter)) + np.uint64(1))
    return int(code[0])


def ranked(codes, counts):
    """The most frequent n-grams' codes, ties by code."""
    if len(codes) > PROFILE:
        least = np.partition(counts, -PROFILE)[-PROFILE]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:PROFILE]


def learn(docs, lang_col="lang", text_col="text", id_col="doc_id", sample_docs=SAMPLE_DOCS):
    """Profiles {language: n-grams}, from the texts with a non-null language.

    The model is fitted on a bounded sample: of each language about ``sample_docs`` documents, those of the
    smallest hashes.  All their words count, summed by language and n-gram.  It is empty if nothing is labelled,
    and has one profile a label, so it is as large as the labels are many.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(id_col, text_col).alias("order"))
    # the hash is even over the 64-bit numbers, so a share of them is that share of the documents
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        "lang", (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(sample_docs) / F.col("n"))).alias("below"))
    share = stored(share, "languages")
    share = F.broadcast(share) if share.count() <= BROADCAST_LABELS else share
    rows = rows.join(share, "lang").filter(F.col("order") <= F.col("below")).dropDuplicates(["lang", "order"])
    grams = rows.select("lang", "text").mapInArrow(count_grams, "lang string, gram bigint, n bigint")
    # ties by the code as an unsigned number
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    best = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(order))
    profiles = best.filter(F.col("place") <= PROFILE).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda g: g.gram).alias("grams"))
    return {r.lang: r.grams for r in profiles.collect()}


def count_grams(batches):
    """Counts of the n-grams of each language, summed over about a slice of text."""
    for part in slices(batches, 1):
        words = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            words.setdefault(lang, []).extend(letters_of(text))
        for lang, found in words.items():
            if found:
                codes, counts = gram_counts(found)
                yield pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes.view(np.int64)),
                                       "n": pa.array(counts)})


class Identifier:
    """Scores whole texts against the profiles."""

    def __init__(self, profiles):
        self.languages = sorted(profiles)
        ranks = [np.array(profiles[name], dtype=np.int64).view(np.uint64) for name in self.languages]
        self.codes = np.unique(np.concatenate(ranks)) if ranks else np.zeros(0, np.uint64)
        self.places = np.full((len(self.codes) + 1, len(ranks)), -1, dtype=np.int64)
        for i, codes in enumerate(ranks):
            self.places[np.searchsorted(self.codes, codes), i] = np.arange(len(codes))

    def score(self, text):
        """Language and a score from 0 to 1: how much nearer the best profile is than the farthest possible."""
        words = letters_of(text) if text and self.languages else []
        if not words:
            return "und", 0.0
        best = ranked(*gram_counts(words))
        at = np.minimum(np.searchsorted(self.codes, best), len(self.codes) - 1)
        place = self.places[np.where(self.codes[at] == best, at, -1)]
        apart = np.where(place < 0, PROFILE, np.abs(place - np.arange(len(best))[:, None])).sum(axis=0)
        winner = int(np.argmin(apart))
        return self.languages[winner], float(1 - apart[winner] / (PROFILE * len(best)))


def identify(docs, profiles, text_col="text"):
    """The input's columns with ``lang_pred`` and ``score`` in place of such columns of its own.

    A null text, one without letters, or an empty model gives ``und`` and 0.  Ties go to the language
    first in order.  Every word of a text counts; repeated rows are answered each.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*kept)
    at = kept.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        judge = Identifier(model.value)
        for part in slices(batches, at):
            found = [judge.score(t) for t in part.column(at).to_pylist()]
            columns = [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    fields = [*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType(fields))


def least_scores(docs, lang_col="lang", text_col="text", id_col="doc_id"):
    """(lang_pred, least): below ``least`` a text is not taken for one of that language.

    Profiles of three quarters of the labelled documents, by a hash of the text, score all of the fourth;
    copies fall on one side.  ``least`` is ``SHARE`` of the score that all but ``LOW`` of a language's own
    documents reach there.  A language of which no such document is recognised has no row.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    held = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    found = identify(rows.filter(held).select("lang", "text"), learn(rows.filter(~held), id_col=id_col))
    steps = found.filter("lang_pred = lang").groupBy("lang_pred", F.floor(F.col("score") * STEPS).alias("step")).agg(
        F.count(F.lit(1)).alias("n"))
    return steps.groupBy("lang_pred").agg((F.percentile("step", LOW, F.col("n")) * (SHARE / STEPS)).alias("least"))
