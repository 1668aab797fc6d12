"""Connected components of an edge table, as joins over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.session import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): least of u and its neighbours. Checkpointed, so that a join on a hot ``u`` is between two plain shuffles."""
    return cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))


def star_pairs(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The same components as (least member, member) pairs; for the links that one task has found."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    members = [x for x in list(parent) if root(x) != x]
    return [root(x) for x in members], members


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` (u below v's name) are stars: no id is under two others, or both under and above one."""
    ends = edges.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not ends.filter("below > 1 or (below = 1 and above = 1)").take(1)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (least id reachable) for every id that ``edges`` (``a, b``) names. Loops and repeats are fine.

    Alternates two star operations until all is stars: each node hands its larger neighbours to the least one it
    knows, then its smaller ones. The rounds grow with the logarithm of a component's size, and no component or list of
    neighbours is ever gathered in one place.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    all_edges = now = cut_lineage(edges)
    now = now.filter("u <> v")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        least = _least_neighbour(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    # in stars every id but the least is under exactly one; ids that only loops name are alone
    named = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    least = now.union(all_edges.filter("u = v")).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return named.union(least).groupBy("id").agg(F.min("component").alias("component"))
