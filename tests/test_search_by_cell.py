"""The search without a stored table hands Python each vector once per cell, in small batches, and holds one cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolore.operators import packs, retrieve
from repolore.plans import flagship


def _vectors(spark, n, id, dim, repos):
    row = F.array(*[(F.pmod(F.hash("id", F.lit(j)), F.lit(2001)) / 1000 - 1).cast("float") for j in range(dim)])
    return spark.range(n).select(F.col("id").alias(id), F.concat(F.lit("r"), F.col("id") % repos).alias("repo"), row.alias("vector"))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _count_bytes(spark, monkeypatch):
    """Bytes that tasks of ``mapInArrow`` are handed."""
    sent = spark.sparkContext.accumulator(0)
    frame = type(spark.range(1))
    real = frame.mapInArrow

    def counted(df, run, schema, *more):
        def told(b):
            sent.add(b.nbytes)
            return b

        return real(df, lambda batches: run(map(told, batches)), schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    return sent


def test_vectors_reach_python_once_per_cell(spark, monkeypatch):
    queries, chunks = _vectors(spark, 8_000, "query_id", 16, 1), _vectors(spark, 20_000, "chunk_id", 16, 1)
    want = _rows(retrieve.search(queries, chunks, 3, True))
    sent = _count_bytes(spark, monkeypatch)
    assert _rows(retrieve.search(queries, chunks, 3, False)) == want
    assert 28_000 * 64 <= sent.value < 28_000 * 64 * 3  # 34.6 MB as pairs of packs, growing with queries x chunks


def test_contexts_of_many_queries(spark, monkeypatch):
    """More queries than may be broadcast: the same contexts, and no pair of packs on the way."""
    queries, chunks = _vectors(spark, 3_000, "query_id", 16, 1), _vectors(spark, 6_000, "chunk_id", 16, 1)
    chunks = chunks.withColumn("file_path", F.concat(F.lit("f"), F.col("chunk_id") % 7)).withColumn("text", F.col("chunk_id").cast("string"))
    want = _rows(retrieve.context_text(flagship.hits(queries, chunks, 4)))
    monkeypatch.setattr(retrieve, "few", lambda queries: False)
    sent = _count_bytes(spark, monkeypatch)
    assert _rows(retrieve.context_text(flagship.hits(queries, chunks, 4))) == want and len(want) == 3_000
    assert 9_000 * 64 <= sent.value < 9_000 * 64 * 3


@pytest.mark.parametrize("floats", [1, 64, 1 << 24])
def test_cells_are_bounded_by_their_numbers(spark, monkeypatch, floats):
    queries, chunks = _vectors(spark, 50, "query_id", 8, 4), _vectors(spark, 300, "chunk_id", 8, 3)
    dirty = spark.createDataFrame(
        [(1_000, "r0", []), (1_001, "r0", None), (1_002, None, [1.0] * 8), (1_003, "r1", [9.0, 9.0]), (None, "r1", [9.0] * 8)],
        "chunk_id bigint, repo string, vector array<float>",
    )
    chunks = chunks.unionByName(dirty)
    monkeypatch.setattr(packs, "CELL_FLOATS", floats)
    got = _rows(retrieve.search(queries, chunks, 5, False, query_block=7))
    score = {}
    c = [(r.chunk_id, r.repo, np.array(r.vector, "float64")) for r in chunks.collect() if r.vector and r.repo and r.chunk_id is not None]
    for q in queries.collect():
        v = np.array(q.vector, "float64")
        best = sorted((-round(float(v @ m), 6), i) for i, repo, m in c if repo == q.repo and len(m) == len(v))[:5]
        score |= {(q.query_id, i): (n + 1, -s) for n, (s, i) in enumerate(best)}
    assert {(q, i) for q, i, _, _ in got} == set(score)
    assert all(score[q, i][0] == rank and abs(score[q, i][1] - s) < 2e-6 for q, i, s, rank in got)


def test_a_task_holds_the_cell_in_hand_only(spark):
    """Batches that cut a cell, and cells that meet in a batch; queries without chunks, and chunks without queries."""
    import pyarrow as pa

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.float32())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["repo", "dim", "cell", "asks", "id", "vector"])

    rows = [("a", 1, 0, False, i, [float(i)]) for i in range(5)] + [("a", 1, 0, True, i, [1.0]) for i in range(3)]
    rows += [("a", 1, 1, True, 9, [1.0]), ("a", 2, 0, False, 7, [1.0, 1.0]), ("b", 1, 0, False, 8, [2.0]), ("b", 1, 0, True, 4, [3.0])]
    want = [(q, i, float(i)) for q in range(3) for i in (4, 3)] + [(4, 8, 6.0)]
    for size in (1, 2, 3, 7, 100):
        batches = [batch(rows[s : s + size]) for s in range(0, len(rows), size)] + [batch(rows).slice(0, 0)]
        for step in (1, 2, 50):
            got = pa.Table.from_batches(list(packs._hits_by_cell(2, step)(iter(batches)))).to_pylist()
            assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == want
