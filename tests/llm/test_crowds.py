"""Crowds of the Jaccard join: sets that only a crowd's representative stood for are compared across tasks."""

import random

import pyarrow as pa
import pytest

from repolore.llm import jaccard_join
from repolore.llm.graph import star_pairs

DDL = "doc_id long, text string"


def template_corpus(seed=3, tasks=2, variants=150, words=320):
    """Rows by task: heavily edited variants of one template, and in each task one copy with a single word changed."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    parts, fresh = [], iter(range(10**6))
    for task in range(tasks):
        texts = []
        for _ in range(variants):
            at = set(rnd.sample(range(words), words // 16))
            texts.append([f"n{next(fresh)}" if i in at else w for i, w in enumerate(base)])
        near = [[f"n{task}" if i == at else w for i, w in enumerate(base)] for at in range(words)]
        # the greatest id of all: no crowd's representative
        texts.append(max(near, key=lambda x: jaccard_join._digest(jaccard_join.shingles(" ".join(x), 3), 0)[0]))
        parts.append([" ".join(x) for x in texts])
    return parts


def brute(texts, k, num):
    sets = [set(jaccard_join.shingles(t, k).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= num * (len(a) + len(sets[j]) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("crowded", [2, 1])
def test_crowds_meet_across_tasks(spark, monkeypatch, crowded):
    """``crowded``: tasks with variants; in the others the near copy is alone, so it meets crowds as a plain set."""
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    parts = [p if t < crowded else p[-1:] for t, p in enumerate(template_corpus())]
    texts = [t for p in parts for t in p]
    want = brute(texts, 3, 90)
    assert max(list(want.values()).count(c) for c in want.values()) == 2  # the near copies, one a task
    frames, at = [], 0
    for p in parts:
        frames.append(spark.createDataFrame([(at + i, t) for i, t in enumerate(p)], DDL).coalesce(1))
        at += len(p)
    table = frames[0]
    for f in frames[1:]:
        table = table.union(f)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(table, 3, (90, 100)).collect()}
    assert got == want


def test_crowds_of_two_tasks_share_a_region(monkeypatch):
    """The steps inside tasks by themselves: the near copies, each in crowds only, must be joined without a bitmap test."""
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    parts = template_corpus()
    sent = [b for p in parts for b in jaccard_join._cells(3, 90, 100, 0, 1)([pa.RecordBatch.from_pydict({"text": p})])]
    edges = []
    for bucket in (-1, 0):
        met = jaccard_join._meet_or_pass(pa.Table.from_batches([b for b in sent if b.column("bucket")[0].as_py() == bucket]))
        edges += [(r["a"], r["b"]) for r in met.to_pylist() if r["cell"] is None]
    least, member = star_pairs(*zip(*edges, strict=True))
    region = dict(zip(member, least, strict=True)) | {x: x for x in least}
    one, two = (jaccard_join._digest(jaccard_join.shingles(p[-1], 3), 0)[0] for p in parts)
    assert region[one] == region[two]
