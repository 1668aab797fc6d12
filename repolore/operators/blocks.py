"""Exact search that leaves blocks of chunks unread: blocks of vectors that lie on one side of fixed planes, each with its centre and
radius. No vector of a block scores more than query . centre + |query| * radius, so a block whose bound is below a query's k-th score
so far cannot change its result.

The blocks and their statistics are made once, when the index is written; store chunks partitioned by ``repo`` and ``block``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.operators import retrieve
from repolore.operators.ordered import top_n
from repolore.session import broadcast_if_small, cut_lineage, fits

_PARTIAL = "repo string, block string, n bigint, total array<double>"


def mark_blocks(chunks: DataFrame, planes: int = 6, seed: int = 7) -> DataFrame:
    """Add ``block``: the vector's size and its sides of ``planes`` seeded planes, so a repository has at most 2**planes blocks a
    size. Null for a chunk without a vector. Nothing is shuffled."""

    @F.pandas_udf("string")
    def block(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        sizes = vectors.map(lambda v: 0 if v is None else len(v))
        for dim in set(sizes) - {0}:
            at = np.flatnonzero(sizes == dim)
            normals = np.random.default_rng([seed, dim]).standard_normal((dim, planes))
            sides = np.stack(vectors.iloc[at]).astype("float64") @ normals > 0
            out.iloc[at] = [f"{dim}:" + "".join("01"[int(s)] for s in row) for row in sides]
        return out

    return chunks.withColumn("block", block(F.col("vector")))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def _doubles(v: str) -> Column:
    return F.col(v).cast("array<double>")


def block_stats(marked: DataFrame) -> DataFrame:
    """(repo, block, n, centre, radius), checkpointed. Sums leave a task once per Arrow batch and block."""
    rows = marked.where("repo IS NOT NULL AND block IS NOT NULL").select("repo", "block", "vector")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (repo, block, len(g), np.stack(g["vector"]).astype("float64").sum(axis=0))
                for (repo, block), g in pdf.groupby(["repo", "block"], sort=False)
            ]
            yield pd.DataFrame(found, columns=["repo", "block", "n", "total"])

    key = ["repo", "block"]
    places = rows.mapInPandas(sums, _PARTIAL).select(*key, "n", F.posexplode("total").alias("i", "x"))
    means = places.groupBy(*key, "i").agg((F.sum("x") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    centres = means.groupBy(*key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("_m"))
    centres = cut_lineage(centres.select(*key, "n", F.col("_m.mean").alias("centre")))
    around = F.broadcast(centres) if fits(centres, 10_000) else centres
    away = _norm(F.zip_with(_doubles("vector"), "centre", lambda a, b: a - b))
    radius = rows.join(around.drop("n"), key).groupBy(*key).agg(F.max(away).alias("radius"))
    return cut_lineage(centres.join(radius, key))


def bounds(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, repo, block, n, bound): what a chunk of the block can score at most, with room for rounding."""
    q = queries.where(F.size("vector") > 0).select("query_id", "repo", _doubles("vector").alias("_q"))
    dot = F.aggregate(F.zip_with("_q", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    reach = _norm(F.col("_q")) * F.col("radius")
    room = 2e-6 + 1e-9 * (_norm(F.col("_q")) * _norm(F.col("centre")) + reach)
    same = q.join(stats, "repo").where(F.size("_q") == F.size("centre"))
    return same.select("query_id", "repo", "block", "n", (dot + reach + room).alias("bound"))


def first_blocks(bound: DataFrame, k: int) -> DataFrame:
    """``bound`` with ``first``: the blocks of highest bound that hold at least ``k`` chunks together."""
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    return bound.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)) < k)


def open_blocks(marked_bounds: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks not read yet that may still change a result, given the hits found in the first ones."""
    kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    rest = marked_bounds.where("NOT first").join(kth, "query_id", "left")
    return rest.where("_kth IS NULL OR bound >= _kth").select("query_id", "repo", "block")


def read_blocks(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chunks of the (repo, block) in ``pairs``. Few of them are also filters on the two columns, which prune a
    partitioned store before anything is read."""
    keys = cut_lineage(pairs.select("repo", "block").distinct())
    if fits(keys, retrieve.MAX_FILTER_REPOS):
        rows = keys.collect()
        chunks = chunks.where(F.col("repo").isin(sorted({r.repo for r in rows})) & F.col("block").isin(sorted({r.block for r in rows})))
    return chunks.join(broadcast_if_small(keys), ["repo", "block"], "left_semi")


def _search_in(queries: DataFrame, chunks: DataFrame, pairs: DataFrame, k: int, **kw) -> DataFrame:
    """Every query against its blocks in ``pairs``: to the search, a block is a repository of its own."""
    own = F.concat("block", F.lit("\x01"), "repo").alias("repo")
    asked = cut_lineage(pairs.join(queries.select("query_id", "vector"), "query_id").select("query_id", own, "vector"))
    return retrieve.search(asked, read_blocks(chunks, pairs).select("chunk_id", own, "vector"), k, **kw)


def search_pruned(queries: DataFrame, chunks: DataFrame, stats: DataFrame, k: int = C.TOP_K, **kw) -> DataFrame:
    """The hits of ``retrieve.search`` (query_id, chunk_id, score, rank), reading only blocks that can matter.

    ``chunks`` with ``block`` and ``stats`` as made by ``mark_blocks`` and ``block_stats``. The blocks of highest bound come
    first; their k-th score decides which others are read. Where bounds tell nothing, all blocks are read, in two steps.
    """
    bound = cut_lineage(first_blocks(bounds(queries, stats), k))
    first = cut_lineage(_search_in(queries, chunks, bound.where("first"), k, **kw))
    rest = cut_lineage(open_blocks(bound, first, k))
    second = _search_in(queries, chunks, rest, k, **kw)
    return top_n(first.unionByName(second).drop("rank"), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
