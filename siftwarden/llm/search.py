"""Ranked lexical search by presence masks.

A chunk of documents is a term-major table of impacts (what a term adds to a document's score).  For an
item, the documents of a chunk are grouped by the mask of the item's terms that they hold.  The terms' largest
impacts, summed over a mask, are the most a document of that mask can score; masks are evaluated by
descending maximum, until the next one is below the k-th score so far.  Terms so light that all of them
together stay below it are left out of the choice of documents.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import slices, stored

# letters and digits of ASCII and all else beyond ASCII make terms; only A-Z are lower-cased
TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PIECE = 1 << 20
BLOCK_TERMS = 1 << 20
CHUNK_DOCS = 1 << 13
CHUNK_POSTINGS = 1 << 21


def terms_in(data):
    """Lists of the terms of a text (UTF-8), about a megabyte of it at a time."""
    data, at = data.translate(TERM_BYTES), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def item_terms(batches):
    for batch in batches:
        for part in slices([batch], 1):
            rows, terms = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                found = set().union(*terms_in(text))
                rows += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())],
                                             names=["item", "term"])


def postings(vocabulary):
    """(id, n, terms, counts) of each text: its number of terms, and those of the vocabulary with their counts."""
    def run(batches):
        known, size = vocabulary.value, len(vocabulary.value)
        for part in slices(batches, 1):
            length, codes, row = [], [np.zeros(0, np.int64)], 0
            for row, text in enumerate(part.column(1).to_pylist()):
                n = 0
                for found in terms_in(text):
                    n += len(found)
                    code = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
                    codes.append(code[code >= 0] + row * size)
                length.append(n)
            code, count = np.unique(np.concatenate(codes), return_counts=True)
            cuts = np.searchsorted(code, np.arange(part.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (code % max(size, 1), count)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int64()), *lists], names=["id", "n", "terms", "counts"])
    return run


def document_counts(size):
    """Documents that hold each term, summed inside the task."""
    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.record_batch({"term": pa.array(at, pa.int64()), "df": pa.array(held[at])})
    return run


class Chunk:
    """Impacts of some documents, by document and by term."""

    def __init__(self, rows, weights, total, length):
        self.id = rows.column("id").combine_chunks()
        n = rows.column("n").to_numpy()
        lists = rows.column("terms").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        self.term, tf = lists.flatten().to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        doc = np.repeat(np.arange(len(n)), size)
        m = 50 + (50 * n * total) // max(length, 1)
        self.impact = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(self.term, kind="stable")
        self.doc_of, sorted_terms = doc[order], self.term[order]
        self.held = np.unique(sorted_terms)
        self.first = np.searchsorted(sorted_terms, self.held)
        self.last = np.append(self.first[1:], len(sorted_terms))
        self.top = np.maximum.reduceat(self.impact[order], self.first) if len(self.held) else np.zeros(0, np.int64)

    def masks(self, places, essential):
        """Documents that hold an essential term, and the mask of all the terms of each, in 64-bit lanes."""
        present = np.zeros(len(self.id), dtype=bool)
        for p in places[essential:]:
            present[self.doc_of[self.first[p]:self.last[p]]] = True
        docs = np.flatnonzero(present)
        row = np.cumsum(present) - 1
        lanes = np.zeros((len(docs), (len(places) + 63) // 64), dtype=np.uint64)
        for j, p in enumerate(places):
            held = self.doc_of[self.first[p]:self.last[p]]
            lanes[row[held[present[held]]], j >> 6] |= np.uint64(1 << (j & 63))
        return docs, lanes

    def scores(self, docs, wanted):
        """Exact scores of documents over the terms that ``wanted`` (by term) marks."""
        size = self.start[docs + 1] - self.start[docs]
        at = np.repeat(self.start[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        running = np.concatenate([[0], np.cumsum(np.where(wanted[self.term[at]], self.impact[at], 0))])
        ends = np.cumsum(size)
        return running[ends] - running[ends - size]

    def best(self, terms, wanted, k, least):
        """Documents and scores, among them every document of the chunk that can be among the best k.

        ``least`` is the k-th score so far, 0 if there are fewer; scores of 0 do not count.
        """
        place = np.searchsorted(self.held, terms)
        place = place[(place < len(self.held)) & (self.held[np.minimum(place, len(self.held) - 1)] == terms)] if len(self.held) else place[:0]
        place = place[self.top[place] > 0]
        place = place[np.argsort(self.top[place], kind="stable")]
        top = self.top[place]
        essential = int(np.searchsorted(np.cumsum(top), max(least, 1)))
        if essential == len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, lanes = self.masks(place, essential)
        masks, group = np.unique(lanes, axis=0, return_inverse=True) if lanes.shape[1] > 1 else np.unique(lanes[:, 0], return_inverse=True)
        masks = masks.reshape(len(masks), -1)
        most = np.zeros(len(masks), dtype=np.int64)
        for j, t in enumerate(top):
            most += ((masks[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64) * t
        order = np.argsort(-most, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        # documents by the rank of their mask, most promising first
        by_rank = np.argsort(rank[group.reshape(-1)], kind="stable")
        docs, bound = docs[by_rank], most[order][rank[group.reshape(-1)][by_rank]]
        found, scored, at, step = [], [], 0, 2 * k
        while at < len(docs) and bound[at] >= max(least, 1):
            # a step ends with a mask
            end = int(np.searchsorted(-bound, -bound[min(at + step, len(docs)) - 1], "right"))
            found.append(docs[at:end])
            scored.append(self.scores(docs[at:end], wanted))
            flat = np.concatenate(scored)
            if len(flat) >= k:
                least = max(least, int(np.partition(flat, len(flat) - k)[len(flat) - k]))
            at, step = end, 2 * step
        docs, scored = np.concatenate(found or [docs[:0]]), np.concatenate(scored or [bound[:0]])
        keep = scored >= max(least, 1)
        return docs[keep], scored[keep]


def rank(block, k):
    """The best k documents of the task's rows for each item of the block."""
    def run(batches):
        names, terms, weights, total, length = block.value
        best = [(pa.array([], pa.int64()), np.zeros(0, np.int64))] * len(names)
        wanted = np.zeros(len(weights), dtype=bool)

        def take(rows):
            chunk = Chunk(pa.Table.from_batches(rows).combine_chunks(), weights, total, length)
            for i, own in enumerate(terms):
                ids, scores = best[i]
                wanted[own] = True
                docs, new = chunk.best(own, wanted, k, int(scores[-1]) if len(scores) == k else 0)
                wanted[own] = False
                if len(docs):
                    ids, scores = pa.concat_arrays([ids, chunk.id.take(pa.array(docs))]), np.concatenate([scores, new])
                    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -scores))[:k]
                    best[i] = ids.take(pa.array(order)), scores[order]

        held, docs, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                part = batch.slice(at, CHUNK_DOCS)
                held.append(part)
                docs, size = docs + part.num_rows, size + len(part.column(2).flatten())
                if docs >= CHUNK_DOCS or size >= CHUNK_POSTINGS:
                    take(held)
                    held, docs, size = [], 0, 0
        if held:
            take(held)
        item = np.repeat(np.arange(len(names)), [len(s) for _, s in best])
        yield pa.record_batch({
            "item": names.take(pa.array(item, pa.int64())), "id": pa.concat_arrays([pa.array([], pa.int64()), *(i for i, _ in best)]),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in best)]))})
    return run


def search(docs, items, k=50, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """(item, rank, id, score): the k documents of highest score above 0 for each item, all if there are fewer.

    A term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))`` over all documents, and adds that times
    ``1e9 tf div (1000 tf + 20 m)``, where m is 50 plus 50 times the document's length over the mean length.  Terms
    are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased.  Equal scores
    go to the smaller id (long), rows without an id last.  Repeated rows are documents each.  Null and empty texts
    have no terms; items without terms, or whose terms no document holds, have no rows; rows of one item id are
    one item.  Other columns are ignored.

    Items are broadcast in blocks of about ``BLOCK_TERMS`` terms; for each block the documents are read once, and
    their postings of the block's terms written to the shared folder.  A task keeps k documents an item.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"),
                        F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    asked = items.select(F.col(item_col).alias("item"),
                         F.coalesce(F.col(item_text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    asked = stored(asked.mapInArrow(item_terms, f"item {kind}, term binary").distinct(), "item-terms")
    blocks = 1 + asked.count() // BLOCK_TERMS
    out = None
    for i in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        words = own.select("term").distinct().orderBy("term").toArrow().column("term").to_pylist()
        code = {w: j for j, w in enumerate(words)}
        grouped = own.groupBy("item").agg(F.collect_list("term").alias("terms")).toArrow()
        terms = [np.sort(np.array([code[w] for w in t], dtype=np.int64)) for t in grouped.column("terms").to_pylist()]
        held = stored(texts.mapInArrow(postings(spark.sparkContext.broadcast(code)),
                                       "id bigint, n bigint, terms array<int>, counts array<int>"), "postings")
        total, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words), dtype=np.int64)
        counted = held.select("terms").mapInArrow(document_counts(len(words)), "term bigint, df bigint")
        counted = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weights = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
        names = grouped.column("item").combine_chunks()
        block = spark.sparkContext.broadcast((names, terms, weights, total, length))
        part = held.mapInArrow(rank(block, k), f"item {kind}, id bigint, score bigint")
        out = part if out is None else out.unionAll(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
