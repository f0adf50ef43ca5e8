"""Connected components of very large graphs, by hooking and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roster.llm.common import stored


def _through(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace nodes of a column by their parents, where they have one."""
    found = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    joined = df.join(found, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_parent", column)).drop("_node", "_parent")


def _to_roots(hooks: DataFrame) -> DataFrame:
    """Follow (node, parent) until every parent is a root; every step doubles the distance."""
    while True:
        hooks = stored(_through(hooks, "parent", hooks), "hooks")
        if hooks.join(hooks.select(F.col("node").alias("_node")), F.col("parent") == F.col("_node"), "left_semi").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that isn't the least of its component, the root.

    Every round hooks each node to its least neighbour, follows the hooks to their ends, and
    replaces the ends of the edges; edges within one node go. At least every other node goes too. The edges shrink round by round and
    nothing but their count reaches the driver. Hubs are hot join keys, which adaptive execution splits.
    """
    maps: list[DataFrame] = []
    edges = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not edges.isEmpty():
        maps.append(hooks := _to_roots(stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks")))
        moved = _through(_through(edges, "a", hooks), "b", hooks).filter("a <> b")
        edges = stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0]
    for later in maps[1:]:
        # nodes that were roots until a later round have their own row there
        roots = _through(roots, "parent", later).unionByName(later.join(roots.select("node"), "node", "left_anti"))
    return stored(roots.select("node", F.col("parent").alias("root")), "roots")
