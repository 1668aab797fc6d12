"""From raw documents to training shards; each stage works on all that the one before it kept.

A null text is an empty one: no words, so the quality rules judge it, no one's copy, no leak, never taken by the mix. Rows with null or
repeated ids are judged by their own columns. Texts of any length are handled whole. Columns beside the documents' own pass through all
stages but the last, whatever their names; empty tables give empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.llm import decontaminate, jaccard_join, mixing, quality_rules, token_shards
from repolore.session import cut_lineage, keep_small, scratch_dir


#: A column name that no table has: the key of a row. Rows with one key agree in all columns, so they are judged alike.
KEY = "own row\x01"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias(KEY))  # a statistic may have the name of a column
    return quality_rules.judge(whole, labels).filter("kept").select(f"`{KEY}`.*")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64(*docs.columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (keyed) less the keys in ``gone``; texts are not moved while the keys, eight bytes each, fit a broadcast."""
    return docs.join(keep_small(gone.select(KEY).distinct(), 1_000_000), KEY, "left_anti")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 and more): the one with the least id, a null id last.

    Of rows that agree in all columns one stays, with or without words; other documents without words are no one's copies.
    """
    keyed = _keyed(docs)
    found = jaccard_join.similar_components(keyed.select(F.col(KEY).alias("doc_id"), "text"), k=5, threshold=(80, 100))
    found = cut_lineage(found.select(F.col("doc_id").alias(KEY), "component_id"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    kept = found.join(keyed.select("doc_id", KEY), KEY).groupBy("component_id").agg(F.min(place)[KEY].alias(KEY))
    out = _without(keyed, found.join(kept, KEY, "left_anti"))
    again = keep_small(found.groupBy(KEY).count().filter("count > 1").select(KEY), 1_000_000)
    if again.isEmpty():
        return out.select(*docs.columns)
    once, several = out.join(again, KEY, "left_anti"), out.join(again, KEY, "left_semi").dropDuplicates([KEY])
    return once.unionByName(several).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    keyed = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.leaks(keyed.select(F.col(KEY).alias("doc_id"), "text"), benchmark, shared=None)
    return _without(keyed, found.select(F.col("doc_id").alias(KEY))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: one row per pass, and one with the words of the blocks taken beyond whole passes."""
    return mixing.taken_rows(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; returns what their records hold."""
    return token_shards.materialise(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram jaccard join", one_per_group),
    ("benchmark decontamination", without_benchmark),
    ("source mix", mix_sources),
    ("token shards", write_tokens),
]

#: Learned rules, similarity and token ids have no SQL form; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_dir(spark, f"stage{i + 1}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
