"""Repair of conversations: the cheapest edits that give a system turn, if any, and pairs of user and assistant.

A conversation's rows are a path through states (nothing yet, after system, after user, after assistant).  Row by
row an edit keeps, reroles or deletes; turns may be inserted anywhere.  The cost to go is found from the end.
Arcs that lie on a cheapest way make a graph, whose nodes are ranked by their audit strings: first by one
letter, then, through pointers that double, by two, four, eight letters, until all have reached the end.  The
ranks are dense numbers of (rank, rank of the node so many letters on), so one round is one sort of pairs.  The
arcs of a node have different letters; its least arc is first by letter and by rank of its end, and the doubled
pointers give every letter of the least path at once.

Rows are dealt by ranges of (conversation, turn), and cut into stretches of bounded size, so a conversation may
lie in any number of tasks.  Those that do are joined by small tables: which row is the first of its kind, the
cost to go at the end of a stretch (a min-plus product of 4 x 4 numbers a stretch), and the state at its start.
"""

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)

from .common import stored

WHITE = " \t\n\x0b\x0c\r"
STRETCH_ROWS = 4096
STRETCH_BYTES = 4 << 20
FLUSH_ROWS = 16384
FAR = 1 << 50
# states: nothing yet, after system, after user, after assistant
AFTER_NEW = np.array([2, 2, 3, 2])
SYSTEM, USER, ASSISTANT, OTHER = range(4)
# state after a kept row, by its first letter and the state before; -1 where it may not be kept
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
LETTERS = np.frombuffer(b"DIKR", np.uint8)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK, REPEATED, CUT_OFF = 4, 8, 16
CARRIED = ("conv", "at", "roles", "texts", "low", "high", "turns")
END_COSTS, END_EDITS = (0, 2 * INSERT, INSERT, 0), (b"", b"II", b"I", b"")


def code_of(role, text):
    """First letter of the role, and whether the text is blank or ends amid a sentence, as bits."""
    initial = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
    body = text.rstrip(WHITE)
    return initial | (BLANK if not body else 0 if body[-1] in ".!?" else CUT_OFF)


def key_of(role, text):
    from xxhash import xxh3_128_digest
    return xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))


def pieces_schema(kind):
    return StructType([
        StructField("conv", kind), StructField("at", LongType()), StructField("open", BooleanType()),
        StructField("roles", ArrayType(StringType())), StructField("texts", ArrayType(StringType())),
        StructField("codes", BinaryType()), StructField("keys", ArrayType(BinaryType())), StructField("low", LongType()),
        StructField("high", LongType()), StructField("turns", LongType())])


def cut(arrow_kind):
    """Stretches of the rows of a task, which come in order; ``keys`` (of rows that may be the first of their kind)
    are told only where the conversation may go on in another task."""
    names = ["conv", "at", "open", "roles", "texts", "codes", "keys", "low", "high", "turns"]
    kinds = [arrow_kind, pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(),
             pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        out, weight = [], 0
        conv, first, whole, seen = None, True, True, set()
        rows, size = [], 0

        def close(end):
            nonlocal number, rows, size, weight
            live = [r for r in rows if r is not None]
            turns = [r[0] for r in live if r[0] is not None]
            open_ = first or end or not whole
            out.append((conv, base + number, open_, [r[1] for r in live], [r[2] for r in live], bytes(r[3] for r in live),
                        [r[4] for r in live] if open_ else [], min(turns, default=None), max(turns, default=None), len(set(turns))))
            number, weight, rows, size = number + 1, weight + len(rows) + size // 256, [], 0

        def flush():
            nonlocal weight
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            weight = 0
            return batch

        started = False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for name, group in groupby(range(batch.num_rows), columns[0].__getitem__):
                if not started or name != conv:
                    if started:
                        close(False)
                        first = False
                    conv, started, whole = name, True, True
                    seen.clear()
                for i in group:
                    if len(rows) >= STRETCH_ROWS or size >= STRETCH_BYTES:
                        whole = False
                        close(False)
                    if columns[4][i]:
                        continue
                    role, text = columns[2][i], columns[3][i]
                    key = key_of(role, text)
                    again = key in seen
                    seen.add(key)
                    rows.append((columns[1][i], role, text, code_of(role, text) | (REPEATED if again else 0), None if again else key))
                    size += len(role) + len(text)
                if weight >= FLUSH_ROWS:
                    yield flush()
        if started:
            close(True)
        if out:
            yield flush()
    return run


class Graph:
    """Costs, cheapest arcs and ranks of some stretches that stand one after the other."""

    def __init__(self, codes, exits):
        """``codes`` is one byte string a stretch; ``exits`` (stretches, 4, k) are costs to go at their ends."""
        self.size = np.array([len(c) for c in codes], dtype=np.int64)
        code = np.frombuffer(b"".join(codes), np.uint8)
        self.initial, self.bound = code & 3, (code & (BLANK | REPEATED)) > 0
        self.extra = np.where((code & CUT_OFF > 0) & ~self.bound, TRUNCATED, 0).astype(np.int64)
        # a stretch of n rows has n + 1 layers of four nodes
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) + np.arange(len(codes))
        self.last = self.first + self.size
        self.go = np.full((len(code) + len(codes), 4, exits.shape[2]), FAR, dtype=np.int64)
        self.go[self.last] = exits
        order = np.argsort(-self.size, kind="stable")
        for back in range(int(self.size.max(initial=0))):
            now = order[:np.searchsorted(-self.size[order], -back)]
            layer = self.last[now] - 1 - back
            self.go[layer] = self.layer(self.go[layer + 1], layer - now)

    def choices(self, after, row):
        """Costs to go by deleting, keeping and reroling a row (by state), before any insertion."""
        free = ~self.bound[row][:, None, None]
        extra = self.extra[row][:, None, None]
        kept = KEPT[self.initial[row]]
        keep = np.take_along_axis(after, np.maximum(kept, 0)[:, :, None], axis=1) + KEEP + extra
        keep = np.where(free & (kept >= 0)[:, :, None], keep, FAR)
        rerole = np.where(free, after[:, AFTER_NEW] + REROLE + extra, FAR)
        return np.minimum(after + DELETE, FAR), np.minimum(keep, FAR), np.minimum(rerole, FAR)

    def layer(self, after, row):
        cost = np.minimum.reduce(self.choices(after, row))
        user, assistant = cost[:, 2], cost[:, 3]
        user, assistant = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
        nothing, system = np.minimum(cost[:, 0], user + INSERT), np.minimum(cost[:, 1], user + INSERT)
        return np.minimum(np.stack([nothing, system, user, assistant], axis=1), FAR)

    def rank(self):
        """Least arc of every node, and its pointers over 1, 2, 4, ... letters; ranks of the audits from each node."""
        go = self.go[:, :, 0]
        inner = np.ones(len(go), dtype=bool)
        inner[self.last] = False
        layer = np.flatnonzero(inner)
        delete, keep, rerole = (c[:, :, 0] for c in self.choices(self.go[layer + 1], np.arange(len(layer))))
        insert = go[layer][:, AFTER_NEW] + INSERT
        best = go[layer]
        here, there = layer[:, None] * 4, (layer[:, None] + 1) * 4
        ends = [there + np.arange(4), here + AFTER_NEW, there + np.maximum(KEPT[self.initial], 0), there + AFTER_NEW]
        cheapest = np.stack([c == best for c in (delete, insert, keep, rerole)]) & (best < FAR)
        nodes = (here + np.arange(4)).reshape(-1)
        least = np.argmax(cheapest, axis=0).reshape(-1)
        reached = cheapest.any(axis=0).reshape(-1)
        self.letter = np.zeros(go.size, dtype=np.uint8)
        self.letter[nodes[reached]] = LETTERS[least[reached]]
        pointer = np.arange(go.size)
        pointer[nodes[reached]] = np.choose(least, [np.broadcast_to(e, best.shape).reshape(-1) for e in ends])[reached]
        # the end has rank 0; ranks by 1, 2, 4, ... letters, until no node is short of the end
        _, self.ranks = np.unique(self.letter, return_inverse=True)
        self.steps = (self.letter > 0).astype(np.int64)
        self.pointers = [pointer]
        while (self.letter[pointer] > 0).any():
            pair = self.ranks.astype(np.int64) * (int(self.ranks.max()) + 1) + self.ranks[pointer]
            _, self.ranks = np.unique(pair, return_inverse=True)
            self.steps = self.steps + self.steps[pointer]
            pointer = pointer[pointer]
            self.pointers.append(pointer)

    def audits(self, stretch, state):
        """Letters of the least path from the start of each stretch in each state (two arrays of equal length)."""
        start = self.first[stretch] * 4 + state
        size = self.steps[start]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        node = np.repeat(start, size)
        for k, pointer in enumerate(self.pointers):
            node = np.where(step >> k & 1, pointer[node], node)
        letters, ends = self.letter[node].tobytes(), np.cumsum(size)
        return [letters[b - n:b] for b, n in zip(ends.tolist(), size.tolist())]


def products(batches):
    """(conv, at, product) of each stretch: cheapest way from each state at its start to each at its end."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    for batch in batches:
        codes = marked(batch)
        graph = Graph(codes, np.broadcast_to(unit, (len(codes), 4, 4)))
        flat = pa.array(graph.go[graph.first].reshape(-1))
        product = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * 16), flat)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("at"), product], names=["conv", "at", "product"])


def ends(batches):
    """Cost to go at the end of each stretch, over stretches by conversation from the last to the first."""
    conv, started, go = None, False, None
    for batch in batches:
        names, exits = batch.column("conv").to_pylist(), []
        for name, product in zip(names, batch.column("product").to_pylist()):
            if not started or name != conv:
                conv, started, go = name, True, np.array(END_COSTS)
            exits.append(go.tolist())
            go = np.minimum((np.array(product).reshape(4, 4) + go).min(axis=1), FAR)
        yield pa.record_batch({"at": batch.column("at"), "exits": pa.array(exits, pa.list_(pa.int64()))})


def marked(batch):
    """Codes with the rows in ``repeats`` marked as repeated."""
    out = batch.column("codes").to_pylist()
    for i, places in enumerate(batch.column("repeats").to_pylist()):
        if places:
            code = np.frombuffer(out[i], np.uint8).copy()
            code[places] |= REPEATED
            out[i] = code.tobytes()
    return out


def solve(batches):
    """``codes`` and ``audits``: the least audit of each stretch, for each state it may begin in."""
    for batch in batches:
        codes = marked(batch)
        exits = np.array([e or END_COSTS for e in batch.column("exits").to_pylist()], dtype=np.int64).reshape(-1, 4, 1)
        graph = Graph(codes, exits)
        graph.rank()
        # a conversation that lies in one stretch begins in state 0
        states = np.where(batch.column("open").to_numpy(zero_copy_only=False), 4, 1)
        stretch = np.repeat(np.arange(len(codes)), states)
        state = np.arange(len(stretch)) - np.repeat(np.cumsum(states) - states, states)
        cuts = np.concatenate([[0], np.cumsum(states)]).astype(np.int32)
        audits = pa.ListArray.from_arrays(pa.array(cuts), pa.array(graph.audits(stretch, state), pa.binary()))
        kept = list(CARRIED)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(codes, pa.binary()), audits],
                                         names=[*kept, "codes", "audits"])


class Repaired:
    """A conversation that is put together from its stretches."""

    def __init__(self, conv, texts):
        self.conv, self.turns = conv, [] if texts else None
        self.state, self.audit, self.digest, self.empty = 0, [], hashlib.sha256(), True
        self.faults, self.cost, self.last, self.span, self.distinct = [0] * 4, 0, None, [None, None], 0

    def turn(self, role, text):
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False
        if self.turns is not None:
            self.turns.append({"role": role, "text": text})

    def edit(self, letters, roles=(), texts=(), codes=b""):
        at = 0
        for letter in letters:
            new = "assistant" if self.state == 2 else "user"
            if letter == 68:
                self.cost, at = self.cost + DELETE, at + 1
                continue
            if letter == 73:
                self.turn(new, "")
                self.cost += INSERT
                self.state = int(AFTER_NEW[self.state])
                continue
            rerole = letter == 82
            self.turn(new if rerole else roles[at], texts[at])
            self.cost += (REROLE if rerole else KEEP) + (TRUNCATED if codes[at] & CUT_OFF else 0)
            self.state = int(AFTER_NEW[self.state] if rerole else KEPT[codes[at] & 3, self.state])
            at += 1
        self.audit.append(letters)

    def add(self, row):
        for code in row["codes"]:
            fault = 0 if code & BLANK else 1 if code & REPEATED else 2 if code & CUT_OFF else None
            if fault is not None:
                self.faults[fault] += 1
            here = code & 3
            if self.last is not None and (self.last, here) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
                self.faults[3] += 1
            self.last = here
        if row["turns"]:
            # a turn may go on over the end of a stretch
            self.distinct += row["turns"] - (self.span[1] == row["low"])
            self.span = [row["low"] if self.span[0] is None else self.span[0], row["high"]]
        self.edit(row["audits"][self.state if len(row["audits"]) > 1 else 0], row["roles"], row["texts"], row["codes"])

    def result(self):
        self.edit(END_EDITS[self.state])
        gaps = self.span[1] - self.span[0] + 1 - self.distinct if self.distinct else 0
        out = [self.conv, gaps, *self.faults, self.cost, b"".join(self.audit).decode(), self.digest.hexdigest()]
        return out if self.turns is None else [*out, self.turns]


def follow(arrow_kind, texts):
    """One row per conversation, over its stretches in order."""
    kinds = [arrow_kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    if texts:
        kinds, names = [*kinds, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))], [*names, "repaired"]

    def table(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        held, out = None, []
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if held is None or held.conv != row["conv"]:
                    if held is not None:
                        out.append(held.result())
                    held = Repaired(row["conv"], texts)
                held.add(row)
            if out:
                yield table(out)
                out = []
        if held is not None:
            yield table([held.result()])
    return run


def repair(turns, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", gone=None, texts=True):
    """One row per conversation: faults, cost, audit and digest of its cheapest repair, and the ``repaired`` turns.

    Faults, the first of a row counting: ``blank`` (only ASCII white space), ``duplicate`` (role and text seen
    earlier), ``truncated`` (does not end in ``.``, ``!`` or ``?``); ``illegal`` counts neighbours whose roles do not
    follow each other, ``gaps`` the turn numbers that are missing.  Edits: keep 0, rerole to user or assistant 1,
    delete 2 (a must for blank and duplicate rows), insert an empty turn 5; a truncated row that stays adds 5.
    ``audit`` has the first letters of the cheapest edits, the least string of equal costs, whose result is an
    optional system turn and pairs of user and assistant.  ``repaired_sha256`` is over ``role:text`` by lines.

    Rows are ordered by turn, null first, ties by role and text.  Null roles and texts are one space; rows
    without an id are one conversation; repeated rows are duplicates.  ``gone`` is a condition on the input: such
    rows are not there, but their conversation is listed; one without rows has zeros and an empty audit.
    ``texts=False`` leaves out ``repaired``.  Other columns are ignored; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    def told(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"),
                        told(text_col).alias("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    kind = rows.schema["conv"].dataType
    arrow_kind = to_arrow_type(kind)
    # the last key splits rows that are equal in all else
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "gone")
    pieces = stored(dealt.mapInArrow(cut(arrow_kind), pieces_schema(kind)), "stretches")
    none = F.lit(None).cast(ArrayType(IntegerType())).alias("repeats")
    told_columns = ["conv", "at", "open", "roles", "texts", "codes", "low", "high", "turns"]
    ended = F.lit(None).cast(ArrayType(LongType())).alias("exits")
    closed = pieces.filter("not open").select(*told_columns, none, ended)

    # a row is repeated if an earlier stretch of its conversation has the same
    keys = pieces.filter("open").select("conv", "at", F.posexplode("keys").alias("place", "key")).filter("key is not null")
    earliest = keys.groupBy("conv", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
    repeats = keys.alias("k").join(earliest.alias("e"), F.expr("k.conv <=> e.conv and k.key = e.key")).filter("at > first")
    repeats = repeats.groupBy("at").agg(F.collect_list("place").alias("repeats"))
    parts = stored(pieces.filter("open").join(repeats, "at", "left").select(*told_columns, "repeats"), "open")
    product = parts.mapInArrow(products, StructType([StructField("conv", kind), StructField("at", LongType()),
                                                     StructField("product", ArrayType(LongType()))]))
    exits = stored(product.repartition("conv").sortWithinPartitions("conv", F.desc("at")).mapInArrow(
        ends, "at bigint, exits array<bigint>"), "ends")
    parts = parts.join(exits, "at")

    def solved(rows):
        kept = [pieces_schema(kind)[n] for n in CARRIED]
        return rows.mapInArrow(solve, StructType([*kept, StructField("codes", BinaryType()), StructField("audits", ArrayType(BinaryType()))]))

    fields = [StructField("conv", kind), *[StructField(n, LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
              StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
    if texts:
        fields.append(StructField("repaired", ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))))
    whole = solved(closed).mapInArrow(follow(arrow_kind, texts), StructType(fields))
    joined = solved(parts).repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(follow(arrow_kind, texts), StructType(fields))
    return whole.unionAll(joined).withColumnRenamed("conv", conv_col)
