"""Connected components of a table of links, by repeated contraction to the smallest neighbour."""

from pyspark.sql import functions as F

from .common import stored


def components(links):
    """(node, component) for every node of ``links(a, b)``; a component is named by its smallest node.

    Each round maps a node to the smallest of itself and its neighbours and renames the links; nodes
    that are no local minimum disappear, so the rounds are about the logarithm of the longest path.
    Rounds are written to the shared folder.  Links may repeat, have either direction or join a node to itself.
    """
    links = stored(links.select("a", "b").filter("a is not null and b is not null").distinct(), "links")
    names = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent")), "parents")
        if names is None:
            names = parent.withColumnRenamed("parent", "component")
        else:
            names = names.join(parent.select(F.col("node").alias("component"), "parent"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component"))
        links = links.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a")
        links = links.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        links = stored(links.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return names
