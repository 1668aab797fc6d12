"""Near copies are found without shuffling texts, whether the map of wanted texts holds or is too small."""

import random

import pytest
from pyspark.sql import functions as F

from repolore.llm import jaccard_join


def _docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 999)}" for _ in range(80)]
        other = [*words[:79], "changed"]
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join(other)), (4 * i + 2, " ".join(words)), (4 * i + 3, None)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (0, "a row with a number that another has too")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("marks", [26, 2])
def test_components_with_and_without_the_map(spark, monkeypatch, marks):
    monkeypatch.setattr(jaccard_join, "MARKS", marks)
    got = jaccard_join.similar_components(_docs(spark)).where("doc_id IS NOT NULL AND doc_id > 0")
    want = F.when(F.col("doc_id") % 4 == 3, F.col("doc_id")).otherwise(F.floor(F.col("doc_id") / 4) * 4)
    assert got.count() == 239 and got.where(F.col("component_id") != want).count() == 0


def test_texts_are_filtered_where_they_lie(spark):
    texts = _docs(spark)
    members = texts.where("doc_id < 40 AND text IS NOT NULL").select(F.xxhash64("doc_id").alias("key")).distinct()
    sets = jaccard_join._wanted_sets(texts, members, 3, 0)
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    assert members.join(sets, "key", "left_anti").isEmpty() and sets.count() < 60
