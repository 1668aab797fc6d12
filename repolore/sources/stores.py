"""Stored chunks and embeddings as partitioned files, wikis in buckets. Writes replace whole records, so a rerun changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.functions import urls
from repolore.session import broadcast_if_small, cut_lineage
from repolore.sources.buckets import BucketStore

CACHE_KEY = ["repo_type", "owner", "repo", "language"]
CACHE_SCHEMA = (
    "kind string, pos bigint, id string, title string, importance string, content string, "
    "file_paths array<string>, related array<string>, provider string, model string, saved_at timestamp, "
    "repo_type string, owner string, repo string, language string"
)


def _replace_partitions(df: DataFrame, keys: list[str], path: str, fmt: str) -> None:
    """REBALANCE lets AQE split the share of a hot key over several files."""
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *keys
    ).format(fmt).save(path)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored rows, or none when nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_chunks(chunks: DataFrame, path: str) -> None:
    _replace_partitions(chunks, ["repo"], path, "parquet")


def read_chunks(spark: SparkSession, path: str, schema) -> DataFrame:
    return _read(spark, path, schema)


def reuse_chunks(files: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored chunks of the repositories asked for, and freshly built ones where nothing is stored.

    ``build`` makes chunk rows from file rows. Stored repositories are never rebuilt.
    """
    wanted = files.select("repo").distinct()
    schema = build(files.limit(0)).schema
    stored = read_chunks(files.sparkSession, path, schema)
    have = broadcast_if_small(stored.select("repo").distinct())
    fresh = build(files.join(have, "repo", "left_anti"))
    return stored.join(broadcast_if_small(wanted), "repo", "left_semi").unionByName(fresh.select(*stored.columns))


EMBEDDING_SCHEMA = "text_hash string, vector array<float>, model string"


def append_embeddings(rows: DataFrame, path: str) -> None:
    rows.select("text_hash", F.col("vector").cast("array<float>").alias("vector"), "model").write.mode(
        "append"
    ).partitionBy("model").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, EMBEDDING_SCHEMA)


# --- wiki cache: a record per (repo_type, owner, repo, language) in a bucket store ------------------------------------


def wiki_cache(spark: SparkSession, path: str) -> BucketStore:
    """The index knows each record's title and number of pages, so lookups and the catalogue open no record."""
    about = {"title": F.max(F.when(F.col("kind") == "wiki", F.col("title"))), "n_pages": F.count_if(F.col("kind") == "page")}
    return BucketStore(spark, path, tuple(CACHE_KEY), CACHE_SCHEMA, about)


def cache_rows(wikis: DataFrame, pages: DataFrame, saved_at: str) -> DataFrame:
    """Wiki header rows and page rows in the stored layout. ``wikis``: cache key, wiki_id, title, provider, model."""
    none = F.lit(None)
    stamp = F.lit(saved_at).cast("timestamp").alias("saved_at")
    key = [F.when(urls.is_supported(F.col("language")), F.col("language")).otherwise("en").alias("language")]
    base = wikis.select("wiki_id", "repo_type", "owner", "repo", *key, "title", "provider", "model")
    head = base.select(
        F.lit("wiki").alias("kind"), F.lit(-1).cast("bigint").alias("pos"), F.col("wiki_id").alias("id"), "title",
        none.cast("string").alias("importance"), none.cast("string").alias("content"),
        none.cast("array<string>").alias("file_paths"), none.cast("array<string>").alias("related"),
        "provider", "model", stamp, *CACHE_KEY,
    )
    p = pages.select("wiki_id", "pos", "id", F.col("title").alias("page_title"), "importance", "content", "file_paths", "related")
    body = p.join(base.drop("title"), "wiki_id").select(
        F.lit("page").alias("kind"), "pos", "id", F.col("page_title").alias("title"), "importance", "content",
        "file_paths", "related", "provider", "model", stamp, *CACHE_KEY,
    )
    return head.unionByName(body)


def upsert_cache(rows: DataFrame, path: str) -> None:
    """Replace the record of every key in ``rows``."""
    wiki_cache(rows.sparkSession, path).write(rows)


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """All rows of whole records, or of those in ``keys``. A record with an unreadable row is left out, like a deleted one."""
    return wiki_cache(spark, path).read(keys)


def lookup_cache(keys: DataFrame, path: str) -> DataFrame:
    """Each key with its record's title and page count; nulls when there is no usable record."""
    wanted = keys.withColumn("language", urls.language_or_default(F.col("language")))
    rows = read_cache(keys.sparkSession, path, wanted)
    found = rows.groupBy(*CACHE_KEY).agg(
        F.max(F.when(F.col("kind") == "wiki", F.col("title"))).alias("title"),
        F.count_if(F.col("kind") == "page").alias("n_pages"),
    )
    return wanted.join(found, CACHE_KEY, "left")


def delete_cache(keys: DataFrame, path: str) -> DataFrame:
    """Delete records by key; returns the status per key. The status is taken before the write; keys with an unsupported
    language are refused."""
    store = wiki_cache(keys.sparkSession, path)
    live = store.index(keys).select(*CACHE_KEY).distinct()
    status = (
        F.when(~F.coalesce(urls.is_supported(F.col("language")), F.lit(False)), "unsupported language")
        .when(F.col("_live"), "deleted")
        .otherwise("not found")
    )
    result = cut_lineage(
        keys.join(live.withColumn("_live", F.lit(True)), CACHE_KEY, "left").withColumn("status", status).drop("_live")
    )
    store.delete(result.where("status = 'deleted'"))
    return result


# --- project catalogue -----------------------------------------------------------------------------------------------


def cache_objects(spark: SparkSession, path: str) -> DataFrame:
    """(name, mtime_ms) per record, from the index alone."""
    name = urls.cache_key(*[F.col(k) for k in CACHE_KEY]).alias("name")
    return wiki_cache(spark, path).index().select(name, F.unix_millis("stored_at").alias("mtime_ms"))


def projects(objects: DataFrame) -> DataFrame:
    """Catalogue rows from (name, mtime_ms), newest first; names that do not parse are skipped."""
    k = objects.withColumn("_k", urls.parse_cache_key(F.col("name"))).where("_k IS NOT NULL")
    return k.select(
        F.col("name").alias("id"), "_k.owner", "_k.repo", F.concat_ws("/", "_k.owner", "_k.repo").alias("name"),
        "_k.repo_type", F.col("mtime_ms").alias("submitted_at"), "_k.language",
    ).orderBy(F.desc("submitted_at"), "id")


def search_projects(catalogue: DataFrame, text: str = "", limit: int | None = None) -> DataFrame:
    """Case-insensitive substring in name, owner, repo or type; all rows for a blank text; newest first."""
    found = catalogue
    if text.strip():
        q = F.lit(text.lower())
        hit = F.lit(False)
        for c in ("name", "owner", "repo", "repo_type"):
            hit = hit | F.contains(F.lower(c), q)
        found = catalogue.where(hit)
    ordered = found.orderBy(F.desc("submitted_at"), "id")
    return ordered.limit(limit) if limit else ordered
