"""Benchmark decontamination: rare seeds of two words find passages, Smith-Waterman alignment scores them.

With a match worth 1 and every error costing 1, a passage that scores s against an item of m words has at least
``s - 1`` pairs of neighbouring matched words, so it misses at most ``m - s`` of the item's ``m - 1`` two-grams.  Hence
one of the ``m - s + 1`` rarest is in it: these, by the number of documents that hold them, are the item's seeds, and
joining on them loses nothing.  The passage also spans at most ``2 m - s`` words; only where so many words hold
``s - 1`` of the item's two-grams is anything aligned.
"""

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import slices, stored

WORD = re.compile(r"\w+")
SCORE = 0.5
BLOCK_WORDS = 1 << 20


def words_of(text):
    return WORD.findall(text.lower())


def item_words(batches):
    for batch in batches:
        for part in slices([batch], 1):
            found = [words_of(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["item", "words"])


class Items:
    """A block of items: their words as numbers, their two-grams, and, once these are counted, their seeds."""

    def __init__(self, table, least):
        words = table.column("words").to_pylist()
        self.names = table.column("item").combine_chunks()
        self.number = {w: i for i, w in enumerate(sorted({w for item in words for w in item}))}
        self.words = [np.array([self.number[w] for w in item], dtype=np.int64) for item in words]
        self.least = [math.ceil(least * len(w) - 1e-9) for w in self.words]
        grams = [self.grams(w) for w in self.words]
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]))
        self.codes = [np.searchsorted(self.known, g) for g in grams]

    def grams(self, words):
        """The two-gram at each word; negative where a word is of no item."""
        return np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] * len(self.number) + words[1:], -1)

    def numbers(self, text):
        found = words_of(text)
        return np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))

    def hits(self, words):
        """Places of a text's two-grams that items have, and which these are."""
        grams = self.grams(words)
        at = np.flatnonzero(grams >= 0)
        code = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        same = self.known[code] == grams[at] if len(self.known) else np.zeros(len(at), dtype=bool)
        return at[same], code[same]

    def choose_seeds(self, df):
        """The rarest two-grams of each item, as (two-gram, item) by two-gram."""
        seeds = [np.unique(c[np.argsort(df[c], kind="stable")[:len(c) - s + 2]]) for c, s in zip(self.codes, self.least)]
        code = np.concatenate([np.zeros(0, np.int64), *seeds])
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(code, kind="stable")
        self.owner = owner[order]
        self.first = np.searchsorted(code[order], np.arange(len(self.known) + 1))

    def joined(self, codes):
        """Items that share a seed with a text of these two-grams."""
        codes = np.unique(codes)
        size = self.first[codes + 1] - self.first[codes]
        at = np.repeat(self.first[codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.unique(self.owner[at]).tolist()


def count_grams(items):
    """Documents that hold each two-gram of the items, summed inside the task."""
    def run(batches):
        block = items.value
        held = np.zeros(len(block.known), dtype=np.int64)
        for part in slices(batches, 0):
            for text in part.column(0).to_pylist():
                held[np.unique(block.hits(block.numbers(text))[1])] += 1
        at = np.flatnonzero(held)
        yield pa.record_batch({"gram": pa.array(at, pa.int64()), "df": pa.array(held[at])})
    return run


def local_scores(item, passage):
    """Best Smith-Waterman score (match 1, mismatch and gap -1) that ends at each word of the passage."""
    step = np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, dtype=np.int64), np.zeros(len(passage) + 1, dtype=np.int64)
    for word in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, 1, -1))
        row = np.maximum.accumulate(new + step) - step
        best = np.maximum(best, row)
    return best


def passages(places, size, least):
    """Stretches (start, end in words) in which an item of ``size`` words may score ``least``, by the places of its two-grams."""
    span = 2 * size - least
    if least < 2 or len(places) < least - 1:
        return
    # the places from which the next ``least - 1`` two-grams lie within the span
    start = places[:len(places) - least + 2]
    start = start[places[least - 2:] + 2 - start <= span]
    if not len(start):
        return
    for group in np.split(start, np.flatnonzero(np.diff(start) > span) + 1):
        # words before the first and behind the last two-gram belong to the passage too
        yield int(group[0]) - span, int(group[-1]) + span


def align(item, words, places, least):
    """Score, and the aligned words of the text, of the best passage; None if none scores ``least``."""
    kinds, x = np.unique(item, return_inverse=True)
    top = None
    for a, b in passages(places, len(item), least):
        a, b = max(a, 0), min(b, len(words))
        place = np.minimum(np.searchsorted(kinds, words[a:b]), len(kinds) - 1)
        y = np.where(kinds[place] == words[a:b], place, -1)
        ends = local_scores(x, y)
        end = int(np.argmax(ends))
        if ends[end] >= least and (top is None or ends[end] > top[0]):
            back = local_scores(x[::-1], y[:end][::-1])
            top = (int(ends[end]), a + end - int(np.argmax(back)), a + end)
    return top and (top[0] / len(item), top[1], top[2])


def find_items(items):
    """The pairs of texts (second column) and items that score enough."""
    def run(batches):
        block = items.value
        wanted = np.zeros(len(block.known), dtype=bool)
        for part in slices(batches, 1):
            rows, found = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                words = block.numbers(text)
                at, codes = block.hits(words)
                for item in block.joined(codes):
                    wanted[block.codes[item]] = True
                    places = at[wanted[codes]]
                    wanted[block.codes[item]] = False
                    if score := align(block.words[item], words, places, block.least[item]):
                        rows.append(i)
                        found.append((item, *score))
            item, score, first, end = list(zip(*found)) or [[]] * 4
            yield pa.record_batch({
                "id": part.column(0).take(pa.array(rows, pa.int64())), "item": block.names.take(pa.array(item, pa.int64())),
                "score": pa.array(score, pa.float64()), "first_word": pa.array(first, pa.int64()),
                "end_word": pa.array(end, pa.int64())})
    return run


def contaminated(docs, benchmark, least=SCORE, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """(id, item, score, first_word, end_word) for documents that hold at least a share ``least`` of an item.

    Words are runs of letters and digits, lower-cased.  Items are joined with the documents that hold one of their
    seeds and aligned where enough of their two-grams are near each other; no passage of the score is lost, however
    many documents hold it and whatever is inserted.  Null texts hold nothing.  An item has at least three words, and
    enough that its least score is 2; others are found nowhere.  Items of equal text are found each.  Repeated rows
    give one row per id and item, that of the best score.  Other columns are ignored.

    The items are broadcast in blocks of about ``BLOCK_WORDS`` words (one, for the usual benchmarks); the documents are
    read twice a block, once to count the documents of each two-gram.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("item_text")).filter(
        "item_text is not null").distinct()
    kind, item_kind = (d.schema[0].dataType.simpleString() for d in (docs.select("id"), items.select("item")))

    items = items.mapInArrow(item_words, f"item {item_kind}, words array<string>")
    items = stored(items.filter((F.size("words") >= 3) & (F.size("words") * least > 1 + 1e-9)), "items")
    blocks = 1 + (items.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS
    found = None
    for i in range(blocks):
        block = Items(items.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i).toArrow(), least)
        counts = docs.select("text").mapInArrow(count_grams(spark.sparkContext.broadcast(block)), "gram bigint, df bigint")
        counts = counts.groupBy("gram").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(block.known), dtype=np.int64)
        df[counts.column("gram").to_numpy()] = counts.column("df").to_numpy()
        block.choose_seeds(df)
        part = docs.mapInArrow(find_items(spark.sparkContext.broadcast(block)),
                               f"id {kind}, item {item_kind}, score double, first_word bigint, end_word bigint")
        found = part if found is None else found.unionAll(part)
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(best).select(id_col, item_col, "best.*")
