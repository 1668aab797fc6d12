"""Exact search for any number of queries over stored packs of vectors: the stored vectors are never shuffled.

A pack is one row of some hundred vectors of one repository, size and cell. Packs are stored in buckets of
(repo, dim, cell); packs of queries are sent to the cells of their repository, and the sort-merge join that Spark makes
of it hands each pair of packs to one product. Only queries and hits move. A hot repository has as many cells as its size
asks for. Scores, ties and results are those of ``retrieve.search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.operators.ordered import top_n
from repolore.operators.retrieve import HIT_SCHEMA, _hits, _score_block
from repolore.session import cut_lineage, keep_small
from repolore.sources import colocated

CELL_KEY = ["repo", "dim", "cell"]
PACK = 512
QUERY_PACK = 256
CELL = 200_000
HELD_QUERIES = 20_000
#: Of a search without a stored table: cells per task, numbers in a cell, and chunks that meet queries at once.
CELLS_PER_TASK = 4
CELL_FLOATS = 1 << 24
BLOCK = 4_096


def _usable(df: DataFrame, number: str) -> DataFrame:
    """Rows that can be searched; a null repository, number or vector is left out."""
    rows = df.where(F.col("repo").isNotNull() & F.col(number).isNotNull() & (F.size("vector") > 0))
    return rows.select("repo", F.size("vector").alias("dim"), F.col(number).alias("id"), "vector")


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: ids, and the vectors one after the other."""
    items = F.collect_list(F.struct("id", "vector")).alias("items")
    return rows.groupBy(*keys, "pack").agg(items).select(
        *keys, F.col("items.id").alias("ids"), F.flatten("items.vector").alias("floats")
    )


def write_packs(
    chunks: DataFrame, name: str, path: str, buckets: int, cell: int = CELL, pack: int = PACK
) -> DataFrame:
    """Store (repo, chunk_id, vector) as packs of about ``pack`` vectors in cells of about ``cell``: one shuffle by cell."""
    rows = _usable(chunks, "chunk_id")
    cells = F.ceil(F.count("*") / F.lit(cell)).cast("int")
    packs = F.ceil(F.count("*") / cells / F.lit(pack)).cast("int")
    sizes = keep_small(rows.groupBy("repo", "dim").agg(cells.alias("cells"), packs.alias("packs")))
    h = F.xxhash64("id")
    placed = rows.join(sizes, ["repo", "dim"]).select(
        "repo", "dim", F.pmod(h, "cells").cast("int").alias("cell"), "id", "vector",
        F.pmod(F.xxhash64(h), "packs").cast("int").alias("pack"),
    )
    return colocated.write(_packed(placed.repartition(buckets, *CELL_KEY), CELL_KEY), name, path, CELL_KEY, buckets)


def _matrix(batch: pa.RecordBatch, row: int, ids: str, floats: str) -> tuple[np.ndarray, np.ndarray]:
    numbers = batch.column(ids)[row].values.to_numpy(zero_copy_only=False)
    flat = batch.column(floats)[row].values.to_numpy(zero_copy_only=False).astype("float64")
    return numbers, flat.reshape(len(numbers), -1)


def _products(k: int, held: int):
    """Task function: pairs of packs in, hits out. The best of a query over a task's packs are merged before they leave;
    at ``held`` queries in hand they leave early, which costs rows and changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in batches:
            for row in range(b.num_rows):
                ids, matrix = _matrix(b, row, "ids", "floats")
                qids, qmatrix = _matrix(b, row, "qids", "qfloats")
                _score_block(matrix, ids, qmatrix, qids, k, kept)
                if len(kept) >= held:
                    yield from _out(kept)
                    kept = {}
        if kept:
            yield from _out(kept)

    def _out(kept: dict) -> list[pa.RecordBatch]:
        return pa.Table.from_pandas(_hits(kept), preserve_index=False).to_batches()

    return run


def pairs_of_packs(queries: DataFrame, packs: DataFrame, query_pack: int = QUERY_PACK) -> DataFrame:
    """Each pack of queries beside each stored pack of its repository and vector size."""
    rows = _usable(queries, "query_id")
    n = F.ceil(F.count("*") / F.lit(query_pack)).cast("int").alias("packs")
    cells = packs.groupBy("repo", "dim").agg((F.max("cell") + 1).alias("cells"))
    sizes = keep_small(rows.groupBy("repo", "dim").agg(n).join(cells, ["repo", "dim"]))
    dealt = rows.join(sizes, ["repo", "dim"]).withColumn("pack", F.pmod(F.xxhash64("id"), "packs").cast("int"))
    asked = _packed(dealt, ["repo", "dim", "cells"]).select(
        "repo", "dim", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"),
        F.col("ids").alias("qids"), F.col("floats").alias("qfloats"),
    )
    return packs.join(asked, CELL_KEY).select("ids", "floats", "qids", "qfloats")


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, bool, np.ndarray, np.ndarray]]:
    """Key of a cell, whether these are queries, ids and vectors, for each stretch of rows that belong together."""
    repos = b.column("repo").dictionary_encode()
    codes = repos.indices.to_numpy()
    dim, cell = (b.column(x).to_numpy() for x in ("dim", "cell"))
    asks = b.column("asks").to_numpy(zero_copy_only=False)
    ids, flat = b.column("id").to_numpy(), b.column("vector").flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(dim, dtype="int64")])
    changes = np.any([x[1:] != x[:-1] for x in (codes, dim, cell, asks)], axis=0)
    for s, e in pairwise([0, *(np.flatnonzero(changes) + 1).tolist(), b.num_rows]):
        key = repos.dictionary[int(codes[s])].as_py(), int(dim[s]), int(cell[s])
        yield key, bool(asks[s]), ids[s:e], flat[starts[s] : starts[e]].reshape(e - s, -1)


def _hits_by_cell(k: int, step: int):
    """Task function: cell after cell, its chunks and then its queries in, hits out. In hand are the chunks of one cell, as narrow as they
    came, and the hits of ``step`` queries; queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks = None, []
        for b in batches:
            for key, asks, ids, vectors in _runs(b) if b.num_rows else ():
                if key != cell:
                    cell, blocks = key, []
                if not asks:
                    blocks += [(ids[s : s + BLOCK].copy(), vectors[s : s + BLOCK].copy()) for s in range(0, len(ids), BLOCK)]
                    continue
                for s in range(0, len(ids), step):
                    kept: dict = {}
                    qmatrix = vectors[s : s + step].astype("float64")
                    for held, matrix in blocks:
                        _score_block(matrix.astype("float64"), held, qmatrix, ids[s : s + step], k, kept)
                    if kept:
                        yield from pa.Table.from_pandas(_hits(kept), preserve_index=False).to_batches()

    return run


def search_unstored(queries: DataFrame, chunks: DataFrame, k: int, cell: int, query_block: int) -> DataFrame:
    """Hits of a search without a stored table: one shuffle of the vectors, and as many copies of a query as its repository has cells.

    Cells hold ``cell`` vectors, or more where that would make more than ``CELLS_PER_TASK`` cells per task in all, since each cell more is one
    more copy of the queries and of their hits; but never more than ``CELL_FLOATS`` numbers, since a task holds one cell. A vector goes to
    Python once per cell, in rows of its own: rows of pairs would fill Arrow's batches up to their limit of bytes.
    """
    rows, asked = _usable(chunks, "chunk_id"), _usable(queries, "query_id")
    held = cut_lineage(rows.groupBy("repo", "dim").agg(F.count("*").alias("n")))
    total = held.agg(F.sum("n")).first()[0] or 0
    most = max(cell, -(-total // (CELLS_PER_TASK * chunks.sparkSession.sparkContext.defaultParallelism)))
    bounded = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.lit(CELL_FLOATS) / F.col("dim"))))
    sizes = keep_small(held.join(asked.select("repo", "dim").distinct(), ["repo", "dim"]).select(
        "repo", "dim", F.ceil(F.col("n") / bounded).cast("int").alias("cells")
    ))
    placed = rows.join(sizes, ["repo", "dim"]).select(
        *CELL_KEY[:2], F.pmod(F.xxhash64("id"), "cells").cast("int").alias("cell"), F.lit(False).alias("asks"), "id", "vector"
    )
    sent = asked.join(sizes, ["repo", "dim"]).select(
        *CELL_KEY[:2], F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("asks"), "id", "vector"
    )
    dealt = placed.unionByName(sent).repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY, "asks")
    return dealt.mapInArrow(_hits_by_cell(k, query_block), HIT_SCHEMA)


def search(
    queries: DataFrame, packs: DataFrame, k: int = C.TOP_K, query_pack: int = QUERY_PACK, held: int = HELD_QUERIES
) -> DataFrame:
    """Top ``k`` (query_id, chunk_id, score, rank) of (query_id, repo, vector) over a table of ``write_packs``."""
    found = pairs_of_packs(queries, packs, query_pack).mapInArrow(_products(k, held), HIT_SCHEMA)
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
