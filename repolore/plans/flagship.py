"""Index build and retrieval in one lazy chain: files to contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolore import constants as C
from repolore.operators import corpus, embed, retrieve
from repolore.plans.fixtures import Tables


def hits(
    queries: DataFrame, vectors: DataFrame, k: int = C.TOP_K, dims: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Search the usable vectors of the repositories asked for, then bring in file and text of the hits.

    ``dims`` (repo, dim): the vector sizes that count, where they are known; else they are found first. ``texts`` (chunk_id,
    file_path, text): the chunks as they were before vectors came to them, where they are at hand; so no text moves with a vector."""
    few = retrieve.few(queries)
    stored = retrieve.only_asked(queries, vectors, few)
    narrow = stored.select("repo", "chunk_id", "vector")
    usable = embed.keep_modal_dim(narrow) if dims is None else embed.keep_dim(narrow, dims)
    found = retrieve.search(queries, usable, k, few)
    few_hits = few and k * retrieve.MAX_BROADCAST_QUERIES <= retrieve.MAX_BROADCAST_HITS
    return retrieve.hydrate(found, stored if texts is None else texts, few_hits=few_hits)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, context) for every conversation over the kept files of its repository."""
    t = Tables(spark, sf_dir)
    vectors, texts = (corpus.exclude_paths(t(x)) for x in ("fx_chunk_vectors", "fx_chunks"))  # by the chunk's own path, so nothing is joined
    return retrieve.context_text(hits(t("fx_queries"), vectors, texts=texts))
