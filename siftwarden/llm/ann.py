"""Nearest neighbours by inner product, over low-dimensional stable projections in a kd-tree.

Vectors get one more component so that all have the same length; then the largest inner product is the
smallest distance.  Gaussian projections to ``PROJECTIONS`` dimensions keep distances so that projected
over true squared distance follows a chi-square law.  A query visits the leaves of a kd-tree over the
projected points by their distance and verifies their vectors; it is done with a leaf when a point as
near as its k-th neighbour so far would, with probability ``CONFIDENCE``, have been met before it.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stored

PROJECTIONS = 8
CONFIDENCE = 0.99
SAMPLE = 20_000
CELL_ROWS = 4096
LEAF_ROWS = 256
QUERY_ROWS = 8192
SALTS = 32


def chi_square_quantile(p, degrees):
    """Quantile for an even number of degrees of freedom, where the law is a finite sum; by bisection."""
    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(dim):
    return np.random.default_rng(dim).normal(size=(dim + 1, PROJECTIONS))


def lifted(vectors, longest):
    """Vectors with the component that brings them to the squared length ``longest``."""
    rest = np.sqrt(np.maximum(longest - (vectors * vectors).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


class Tree:
    """A balanced kd-tree of ``depth`` levels; ``axis`` and ``cut`` by node, breadth first."""

    def __init__(self, points, depth):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
        parts = [np.asarray(points)]
        for node in range((1 << depth) - 1):
            part = parts[node]
            if len(part):
                self.axis[node] = np.argmax(part.max(axis=0) - part.min(axis=0))
                self.cut[node] = np.median(part[:, self.axis[node]])
            over = part[:, self.axis[node]] > self.cut[node]
            parts += [part[~over], part[over]]

    def leaf(self, points):
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def box_distance(points, low, high):
    """Squared distance of points to boxes: one row per point, one column per box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        gap = np.maximum(np.maximum(low[:, axis] - p, p - high[:, axis]), 0)
        out += gap * gap
    return out


def by_dimension(frame):
    """The frame's rows by the dimension of their vectors, with these as a matrix."""
    for dim, part in frame.groupby(frame["vec"].map(len)):
        yield dim, part, np.stack(part["vec"].to_numpy()).astype(np.float64)


def search_leaves(points, queries, k, longest, limit):
    """Best k points of one cell for each query; ``bound`` is the k-th score a query has already."""
    out = []
    for dim, q, qv in by_dimension(queries):
        p = points[points["vec"].map(len) == dim]
        if not len(p):
            continue
        pv, reps = np.stack(p["vec"].to_numpy()).astype(np.float64), p["rep"].to_numpy()
        gauss = projection(dim)
        placed, asked = lifted(pv, longest) @ gauss, qv @ gauss[:-1]
        tree = Tree(placed, max(0, math.ceil(math.log2(len(pv) / LEAF_ROWS))))
        leaf = tree.leaf(placed)
        number = [np.flatnonzero(leaf == i) for i in np.unique(leaf)]
        apart = box_distance(asked, np.array([placed[n].min(axis=0) for n in number]),
                             np.array([placed[n].max(axis=0) for n in number]))
        bound, length = q["bound"].to_numpy().copy(), (qv * qv).sum(axis=1)
        best = np.full((len(q), k), -np.inf)
        rep = np.full((len(q), k), np.iinfo(np.int64).max)
        for at in np.argsort(apart.mean(axis=0)):
            reach = limit * np.maximum(length + longest - 2 * bound, 0)
            near = np.flatnonzero(~(apart[:, at] > reach))
            if not len(near):
                continue
            own = number[at]
            score = np.concatenate([best[near], qv[near] @ pv[own].T], axis=1)
            name = np.concatenate([rep[near], np.broadcast_to(reps[own], (len(near), len(own)))], axis=1)
            order = np.lexsort((name, -score), axis=1)[:, :k]
            best[near], rep[near] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
            bound[near] = np.maximum(bound[near], best[near, k - 1])
        found = best > -np.inf
        row, _ = np.nonzero(found)
        out.append(pd.DataFrame({"asker": q["rep"].to_numpy()[row], "rep": rep[found], "score": best[found]}))
    return pd.concat(out) if out else pd.DataFrame({"asker": [], "rep": [], "score": []}).astype(
        {"asker": "int64", "rep": "int64", "score": "float64"})


def nearest(vectors, is_query, k=20, id_col="vec_id", vec_col="embedding"):
    """(query_id, rank, vec_id, score): the k rows of largest inner product to each query row, itself left out.

    ``is_query`` is a condition on the input.  Scores are in double precision; ties go to the smaller id
    (long).  Vectors that are null, empty or zero, or hold a null or non-finite component, and rows without
    an id take no part; only vectors of equal dimension meet.  Equal vectors are searched once, by the k + 1 smallest of
    their ids; more cannot be among k neighbours.  The tree's cells are cut on a sample of ``SAMPLE``
    vectors, but all are indexed.  Repeated ids count as rows each.  Other columns are ignored.
    """
    spark, more = vectors.sparkSession, k + 1
    good = F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("asks")).filter(good & F.col("id").isNotNull())
    salted = F.row_number().over(Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id"))
    single = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.select("id", "vec").withColumn("n", salted).filter(F.col("n") <= more)
    few = few.withColumn("n", single).filter(F.col("n") <= more)
    points = stored(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "rep", F.element_at("ids", 1)), "points")
    askers = stored(rows.filter("asks").select(F.col("id").alias("query_id"), "vec").join(
        points.select("vec", "rep"), "vec").select("query_id", "rep"), "askers")

    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    total, longest = points.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(1.0))).first()
    sample = points.select("rep", "vec").orderBy(F.xxhash64("rep")).limit(SAMPLE).toPandas()
    depth = min(10, max(0, math.ceil(math.log2(max(total, 1) / CELL_ROWS))))
    salts = max(1, math.ceil(total / (CELL_ROWS << (depth + 1))))
    trees = {dim: Tree(lifted(v, longest) @ projection(dim), depth) for dim, _, v in by_dimension(sample)} if len(sample) else {}
    limit = chi_square_quantile(CONFIDENCE, PROJECTIONS)

    def locate(frames):
        for frame in frames:
            for dim, part, v in by_dimension(frame) if len(frame) else ():
                placed = lifted(v, longest) @ projection(dim)
                cell = trees[dim].leaf(placed) if dim in trees else np.zeros(len(part), dtype=np.int64)
                yield part.assign(cell=cell, dim=dim, low=list(placed))

    located = stored(points.select("rep", "vec").mapInPandas(
        locate, "rep bigint, vec array<double>, cell bigint, dim int, low array<double>"), "located")
    ends = [f(F.col("low")[i]).alias(f"{name}{i}") for name, f in (("a", F.min), ("b", F.max)) for i in range(PROJECTIONS)]
    boxes = located.groupBy("dim", "cell").agg(*ends).toPandas()  # at most 1024 cells for each dimension
    asking = stored(located.join(askers.select("rep").distinct(), "rep", "left_semi").select("dim", "cell", "rep", "vec"), "asking")
    indexed = located.select("dim", "cell", F.pmod(F.xxhash64("rep"), F.lit(salts)).alias("salt"), "rep", "vec")

    def visited(visits):
        """Search of the cells in ``visits(dim, cell, rep, vec, bound)``, at most about ``QUERY_ROWS`` queries at a time."""
        most = visits.groupBy("dim", "cell").count().agg(F.max("count")).first()[0] or 1
        blocks = math.ceil(most / QUERY_ROWS)
        left = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = visits.withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))),
                                    "block": F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")})
        key = ["dim", "cell", "salt", "block"]
        return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(
            lambda points, queries: search_leaves(points, queries, more, longest, limit), "asker bigint, rep bigint, score double")

    # first the query's own cell; its k-th score there bounds how far it must look
    own = stored(visited(asking.select("dim", "cell", "rep", "vec", F.lit(float("-inf")).alias("bound"))), "own")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "rep")
    bounds = own.withColumn("n", F.row_number().over(best)).filter(F.col("n") == more).select(
        F.col("asker").alias("rep"), F.col("score").alias("bound"))

    def choose(frames):
        for frame in frames:
            for dim, part, v in by_dimension(frame) if len(frame) else ():
                there = boxes[boxes["dim"] == dim]
                low = there[[f"a{i}" for i in range(PROJECTIONS)]].to_numpy()
                high = there[[f"b{i}" for i in range(PROJECTIONS)]].to_numpy()
                reach = limit * np.maximum((v * v).sum(axis=1) + longest - 2 * part["bound"].to_numpy(), 0)
                cells = there["cell"].to_numpy()
                wanted = ~(box_distance(v @ projection(dim)[:-1], low, high) > reach[:, None])
                wanted &= cells[None] != part["cell"].to_numpy()[:, None]
                row, at = np.nonzero(wanted)
                yield pd.DataFrame({"dim": dim, "cell": cells[at], "rep": part["rep"].to_numpy()[row],
                                    "vec": part["vec"].to_numpy()[row], "bound": part["bound"].to_numpy()[row]})

    asking = asking.join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    visits = stored(asking.select("dim", "cell", "rep", "vec", "bound").mapInPandas(
        choose, "dim int, cell bigint, rep bigint, vec array<double>, bound double"), "visits")
    found = own.unionAll(visited(visits)).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= more)
    found = found.join(points.select("rep", "ids"), "rep").select("asker", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= more)
    each = askers.withColumnRenamed("rep", "asker").join(found, "asker").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
