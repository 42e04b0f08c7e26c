"""Connected components of a graph held as a table of edges: alternating large-star and small-star steps.

Each step is a grouped minimum (summed up before its shuffle) and a join back; a hub's edges stay rows of
their own and are never gathered in one place. Every round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Far more than any graph needs: the number of rounds grows with the logarithm of a component's size.
MAX_ROUNDS = 60


def _to_minimum(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _to_minimum(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of those."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _to_minimum(down, least).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v", F.lit(1)) % 1_000_003).alias("s")).first()
    return tuple(row)


def roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of a link between two nodes; a component's root is its smallest node."""
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        edges = written(_small_star(_large_star(edges).filter("u <> v").distinct()).filter("u <> v").distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    root = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(root)
