"""Leaks by windows that many items share: found, also where none of an item's rarer windows matches."""

import random

import corpus_pipeline
from repolore.llm import decontaminate, queries

from .test_templates import brute, sentence

OPENING = "read the passage below with care and then give a short answer to the question about"
ITEMS = [(i, f"{OPENING} q{i}x z{i}y") for i in range(20)]


def test_against_brute_force_without_a_bound(spark):
    rnd = random.Random(5)
    items = [(i, sentence(rnd, rnd.randint(1, 25))) for i in range(25)] + [(100 + i, f"{OPENING} {sentence(rnd, 4)}") for i in range(25)]
    items += [(200 + i, f"{sentence(rnd, 9)} {OPENING} {sentence(rnd, 9)}") for i in range(10)] + [(7, None), (8, ""), items[3], (300, items[3][1])]
    texts = []
    for _ in range(20):
        words = (rnd.choice(items)[1] or "").split(" ")
        words[rnd.randrange(len(words))] = rnd.choice(["Maria", "99", "stone"])
        texts.append(f"{sentence(rnd, 9)} {' '.join(words)} {sentence(rnd, 9)}")
    texts += [f"{OPENING} {OPENING}", OPENING, f"once {OPENING} we met", None, "", "x"]
    rows = list(enumerate(texts))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"share": 0.8}, {"share": 0.1}, {"width": 4, "plain": 1}):
        got = decontaminate.leaks(docs, table, shared=None, **options).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, items, shared=10**9, **options)


def test_query_and_pipeline_have_no_bound(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"once {OPENING} something else"), (2, "nothing of it")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op7_decontaminate"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched, r.n_item) for r in found) == [(1, i, 16, 18) for i in range(20)]
    assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()] == [2]
