"""Embedding and model calls hold few rows as Python objects, however many a task is handed at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from repolore.operators import embed, generate, retrieve


class Caught:
    """Stands for a DataFrame and gives the task's function."""

    def __init__(self, ddl):
        self.schema = T._parse_datatype_string(ddl)

    def mapInArrow(self, run, schema):
        return run


def _batch(n, **columns):
    return pa.RecordBatch.from_pydict({"id": list(range(n)), **columns})


def test_vectors_leave_in_slices_and_batches_stay_whole(spark):
    n = 5_000
    texts = [None if i % 7 == 0 else " " if i % 7 == 1 else f"t{i}" for i in range(n)]
    asked = []

    class Spy(embed.HashEmbedder):
        def __call__(self, texts):
            asked.append(len(texts))
            return super().__call__(texts)

    got = list(embed.embed(Caught("id bigint, text string"), lambda: Spy(4), batch_size=300)(iter([_batch(n, text=texts)])))
    assert max(b.num_rows for b in got) <= 2 * embed.SLICE + 300
    sent = sum(bool(t and t.strip()) for t in texts)
    assert asked == [300] * (sent // 300) + [sent % 300]
    table = pa.Table.from_batches(got)
    assert table.column("id").to_pylist() == list(range(n)) and table.column("text").to_pylist() == texts
    want = embed.HashEmbedder(4)
    for t, v in zip(texts, table.column("vector").to_pylist(), strict=True):
        assert np.array_equal(v, want([t])[0] if t and t.strip() else np.zeros(4))


def test_lists_and_answers_leave_in_slices(spark):
    n = 2_000
    got = list(embed.embed_lists(Caught("id bigint, texts array<string>"), lambda: embed.HashEmbedder(2))(iter([_batch(n, texts=[["a", None], None, []] * 666 + [["b"]] * 2)])))
    assert max(b.num_rows for b in got) <= embed.SLICE
    assert [None if v is None else len(v) for v in pa.Table.from_batches(got).column("vectors").to_pylist()] == [2, None, 0] * 666 + [1] * 2
    assert not list(embed.embed(Caught("text string"), embed.HashEmbedder)(iter([_batch(0, text=pa.array([], pa.string()))])))
    prompts = [None if i % 9 == 0 else f"p{i}\nmore" for i in range(n)]
    got = list(generate.generate(Caught("id bigint, prompt string"), generate.EchoGenerator)(iter([_batch(n, prompt=prompts)])))
    assert max(b.num_rows for b in got) <= generate.SLICE
    table = pa.Table.from_batches(got)
    assert table.column("response").to_pylist() == [p and f"echo: {p.split()[0]}" for p in prompts]
    assert table.column("prompt").to_pylist() == prompts


def test_only_scores_that_can_count_are_sorted(monkeypatch):
    rng = np.random.default_rng(2)
    matrix, queries = np.round(rng.standard_normal((4_000, 4)), 1), np.round(rng.standard_normal((6, 4)), 1)
    ids, qids, seen, best = np.arange(4_000), np.arange(6), [], retrieve._best
    monkeypatch.setattr(retrieve, "_best", lambda s, i, k: seen.append(len(s)) or best(s, i, k))
    kept = {}
    for start in range(0, 4_000, 100):
        retrieve._score_block(matrix[start : start + 100], ids[start : start + 100], queries, qids, 5, kept)
    assert sum(seen) < 6 * 4_000 / 4
    for q in qids:
        score = np.round(queries[q] @ matrix.T, 6)
        assert kept[q][1].tolist() == np.lexsort((ids, -score))[:5].tolist()
