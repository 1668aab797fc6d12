"""Sources of any length take near their targets, beside one of millions of words."""

from collections import Counter

import pytest

from repolore.llm import mixing

DDL = "doc_id long, text string, source string"


def taken_and_goal(mixed):
    taken = Counter()
    for r in mixed:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    return taken, {r.source: r.target for r in mixed}


def test_small_source_beside_a_large_one(spark):
    rows = [(i, "w " * 100, "large") for i in range(120)] + [(1000 + i, f"s{i} b c d e", "small") for i in range(80)]
    taken, goal = taken_and_goal(mixing.mix(spark.createDataFrame(rows, DDL), block=16, shard_words=200).collect())
    assert all(abs(taken[s] - goal[s]) <= 16 + 0.03 * goal[s] for s in goal), (taken, goal)


@pytest.mark.parametrize("small", [range(1, 201, 7), range(150, 400, 20)])
def test_sources_of_few_words_beside_millions(spark, small):
    large = spark.range(2_000).selectExpr("id as doc_id", "repeat('w ', 5000) as text", "'large' as source")
    rows = [(10_000 + i, "s " * n, f"a{i:03d}") for i, n in enumerate(small)]
    docs = large.unionByName(spark.createDataFrame(rows, DDL))
    taken, goal = taken_and_goal(mixing.mix(docs).collect())
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(1, t / 16), (s, taken[s], t)
