"""Packing: consecutive documents are cut into windows of one length by dynamic programming.

The order of the input is kept.  A window may end after a document (no penalty), after a sentence
(small penalty) or, where neither is near a full window, anywhere (larger penalty).  The cuts minimise padding plus
penalties; the best predecessor of a cut is the minimum of a sliding window, kept in a monotone queue.
"""

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

CHUNK_TOKENS = 1 << 20


def best_cuts(candidates, penalties, length):
    """Positions at which windows end, the last candidate included, minimising padding plus penalties.

    ``candidates`` ascend, and no two neighbours (nor 0 and the first) are more than ``length`` apart.
    cost(i) = penalty(i) + length - at(i) + min of (cost(j) + at(j)) over at(i) - length <= at(j) < at(i).
    Ties go to the longer window.
    """
    at, fine = candidates.tolist(), penalties.tolist()
    before = [0] * len(at)
    queue = deque([(0, 0, -1)])  # (cost + position, position, index), ascending in both
    for i, p in enumerate(at):
        while queue[0][1] < p - length:
            queue.popleft()
        key, _, j = queue[0]
        before[i] = j
        key += fine[i] + length
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, p, i))
    cuts, i = [], len(at) - 1
    while i >= 0:
        cuts.append(at[i])
        i = before[i]
    return np.array(cuts[::-1], dtype=np.int64)


def cut_candidates(ids, doc_ends, sentence_end, length, sentence_penalty, anywhere_penalty):
    """Document ends, sentence ends and, as cuts anywhere, one window's length after each of them.

    Stretches longer than a window get a cut anywhere every ``length`` tokens.
    """
    at = np.union1d(np.flatnonzero(sentence_end[ids]) + 1, doc_ends)
    fine = np.where(np.isin(at, doc_ends, assume_unique=True), 0, sentence_penalty)
    left = np.concatenate([[0], at[:-1]])
    more = (at - left - 1) // length
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    hard = np.union1d(np.repeat(left, more) + step * length, at + length)
    hard = np.setdiff1d(hard[hard < at[-1]], at, assume_unique=True)
    both = np.concatenate([at, hard])
    order = np.argsort(both)
    return both[order], np.concatenate([fine, np.full(len(hard), anywhere_penalty)])[order]


def pack(docs, length=1024, end_id=0, sentence_penalty=4, anywhere_penalty=16, tokenizer=None,
         id_col="doc_id", text_col="text"):
    """Sequences of at most ``length`` tokens; one row per piece of a document in a sequence.

    Columns: the id, ``start`` (the document's ids before the piece), ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens`` (with ``end_id``, which follows each document),
    ``sequence_id`` (unique, ascending inside a partition) and ``offset`` (in the sequence).
    Null and empty texts are documents of the end id alone; a null id stays null, repeated rows are
    packed each; other columns are ignored; an empty table gives an empty one.  A text of any length
    is spread over as many sequences as it needs.  Nothing is shuffled: a partition is packed in its
    order, in chunks of about a million tokens, and a chunk's last window is the only one that may be
    left far from full.
    """
    def run(batches):
        from pyspark import TaskContext

        bpe = encoder(tokenizer)
        enders = np.zeros(max(bpe.words.values()) + 2, dtype=bool)
        enders[[i for w, i in bpe.words.items() if w[-1:] in (b".", b"!", b"?", b"\n")]] = True
        enders[end_id] = False
        sequence = TaskContext.get().partitionId() << 33
        held, names, counts, size = [], [], [], 0

        def chunk():
            nonlocal sequence
            ids, doc_counts = np.concatenate(held), np.concatenate(counts)
            doc_ends = np.cumsum(doc_counts)
            window_ends = best_cuts(*cut_candidates(ids, doc_ends, enders, length, sentence_penalty, anywhere_penalty),
                                    length)
            ends = np.union1d(window_ends, doc_ends)
            starts = np.concatenate([[0], ends[:-1]])
            doc, window = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(window_ends, starts, "right")
            window_starts = np.concatenate([[0], window_ends[:-1]])
            edges = pa.py_buffer(np.concatenate([starts, ends[-1:]]) * 4)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, edges, pa.py_buffer(ids)])
            out = pa.record_batch({
                id_col: pa.concat_arrays(names).take(pa.array(doc)), "start": starts - (doc_ends - doc_counts)[doc],
                "length": ends - starts, "ids": pieces.cast(pa.binary()), "doc_tokens": doc_counts[doc],
                "sequence_id": sequence + window, "offset": starts - window_starts[window],
            })
            sequence += len(window_ends)
            return out

        for part in slices(batches, 1):
            ids, n = bpe.encode(part.column(1).to_pylist(), end_id)
            held.append(ids)
            counts.append(n)
            names.append(part.column(0))
            size += len(ids)
            if size >= CHUNK_TOKENS:
                yield chunk()
                held, names, counts, size = [], [], [], 0
        if size:
            yield chunk()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
              "offset bigint")
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
