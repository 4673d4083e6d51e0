"""Connected components of a graph by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decretum.llm.common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs).

    In each round every node points to the smallest of itself and its neighbours, in
    the order of a digest, and the graph is contracted along the pointers; the
    digest keeps long chains from shrinking by one node a round. A node with very many neighbours
    is reduced before the shuffle. The rounds' pointers, ever fewer, are
    put together backwards. Null ends and loops are left out; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    pointers: list[DataFrame] = []
    while not both.isEmpty():
        least = F.min_by("b", F.struct(F.xxhash64("b"), "b"))
        near = both.groupBy("a").agg(least.alias("m"))
        lower = F.struct(F.xxhash64("m"), "m") < F.struct(F.xxhash64("a"), F.col("a").alias("m"))
        step = settle(near.select(F.col("a").alias("node"), F.when(lower, F.col("m")).otherwise(F.col("a")).alias("root")))
        pointers.append(step)
        first, second = step.toDF("a", "ra"), step.toDF("b", "rb")
        moved = both.where("a < b").join(first, "a").join(second, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        both = settle(moved.union(moved.select("b", "a")).distinct())

    def compose(later: DataFrame, step: DataFrame) -> DataFrame:
        ends = later.toDF("root", "_end")
        return settle(step.join(ends, "root", "left").select("node", F.coalesce("_end", "root").alias("root")))

    if not pointers:
        return both.toDF("node", "root")
    return reduce(compose, reversed(pointers))
