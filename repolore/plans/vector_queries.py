"""Embedding upkeep and retrieval."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import text as X
from repolore.operators import blocks, converse, corpus, embed, packs, retrieve
from repolore.plans import flagship
from repolore.plans.registry import query, sql_in, sql_list
from repolore.session import cut_lineage, scratch_dir
from repolore.sources import colocated

DIM = 64
_hash64 = partial(embed.HashEmbedder, DIM)


def _norm():
    return F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4)


@query("emb1_batch_embed", """SELECT chunk_id, 64 AS dim, CASE WHEN ord%3=1 OR trim(text, chr(32)||chr(9)||chr(10)||chr(13)) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm,
   NULL::VARCHAR AS error FROM (SELECT chunk_id, 0 AS ord, text FROM fx_chunks UNION ALL SELECT -1 - chunk_id, 1, '' FROM fx_chunks WHERE ord%3=1)""",
       ("fx_chunks",))
def _(t):
    """Every chunk, and blank ones beside them."""
    c = t.chunks()
    blank = c.where(F.col("ord") % 3 == 1).select((-1 - F.col("chunk_id")).alias("chunk_id"), F.lit("  ").alias("text"))
    c = c.select("chunk_id", "text").unionByName(blank)
    return embed.embed(c, _hash64).select("chunk_id", F.size("vector").alias("dim"), _norm().alias("norm"), "error")


_BLANKED = "SELECT chunk_id, CASE WHEN ord%3=1 THEN '  ' WHEN doc_id%50=7 THEN NULL ELSE text END AS text, vector FROM fx_chunk_vectors"


@query("emb2_zero_blank", f"""SELECT chunk_id, text IS NULL OR trim(text, chr(32)||chr(9)||chr(10)||chr(13)) = '' AS blank,
   CASE WHEN text IS NULL OR trim(text, chr(32)||chr(9)||chr(10)||chr(13)) = '' THEN 0.0 ELSE vector[1]::DOUBLE END AS first
  FROM ({_BLANKED})""", ("fx_chunk_vectors",))
def _(t):
    d = t("fx_chunk_vectors").selectExpr(
        "chunk_id", "CASE WHEN ord%3=1 THEN '  ' WHEN doc_id%50=7 THEN NULL ELSE text END AS text", "vector"
    )
    fixed = embed.zero_blank(F.col("text"), F.col("vector"), DIM)
    return d.select("chunk_id", X.is_blank(F.col("text")).alias("blank"), F.get(fixed, F.lit(0)).cast("double").alias("first"))


@query("emb3_failed_batches", """SELECT doc_id, CASE WHEN contains(text, 'the') THEN 0 ELSE 64 END AS dim,
  CASE WHEN contains(text, 'the') THEN 'embedding service refused the batch' END AS error FROM documents""")
def _(t):
    make = partial(embed.HashEmbedder, DIM, "the")
    out = embed.embed(t("documents").select("doc_id", "text"), make, batch_size=1)
    return out.select("doc_id", F.size("vector").alias("dim"), "error")


@query("emb3_shared_batches", """SELECT doc_id, k, CASE WHEN contains(text, 'the') AND k <> 1 THEN 0 ELSE 64 END AS dim,
   CASE WHEN contains(text, 'the') THEN 'embedding service refused the batch' END AS error
  FROM documents, (SELECT unnest([0, 1, 2]) AS k) WHERE text IS NOT NULL""")
def _(t):
    """A document shares its batch with a short text and a blank one: refused, it takes the first along."""
    d = t("documents").where("text IS NOT NULL").select("doc_id", F.array(F.lit("plain"), F.lit(" "), "text").alias("texts"))
    out = embed.embed_lists(d, partial(embed.HashEmbedder, DIM, "the"))
    return out.select("doc_id", "error", F.posexplode("vectors").alias("k", "vector")).select(
        "doc_id", "k", F.size("vector").alias("dim"), "error"
    )


_USABLE = "len(vector) > 0"


@query("emb4_first_dim", f"""SELECT v.repo, v.chunk_id, len(v.vector)::INTEGER AS dim FROM fx_dirty_vectors v
   JOIN (SELECT repo, arg_min(len(vector), chunk_id) AS d FROM fx_dirty_vectors WHERE {_USABLE} GROUP BY repo) m
   ON m.repo = v.repo AND len(v.vector) = m.d""", ("fx_dirty_vectors",))
def _(t):
    return embed.keep_first_dim(t("fx_dirty_vectors")).select("repo", "chunk_id", F.size("vector").alias("dim"))


_MODAL = f"""modal AS (SELECT repo, d FROM (SELECT repo, len(vector) AS d, row_number() OVER (PARTITION BY repo
   ORDER BY count(*) DESC, min(chunk_id)) AS rn FROM fx_dirty_vectors WHERE {_USABLE} GROUP BY repo, len(vector)) WHERE rn = 1)"""


@query("emb5_modal_dim", """SELECT v.repo, v.chunk_id, len(v.vector)::INTEGER AS dim FROM fx_dirty_vectors v JOIN modal m
   ON m.repo = v.repo AND len(v.vector) = m.d""", ("fx_dirty_vectors",), ctes=_MODAL)
def _(t):
    return embed.keep_modal_dim(t("fx_dirty_vectors")).select("repo", "chunk_id", F.size("vector").alias("dim"))


@query("emb6_coverage", f"""SELECT v.repo, count(*) AS total, count(*) FILTER (vector IS NULL) AS missing,
   count(*) FILTER (len(vector) = 0) AS empty, count(*) FILTER (len(vector) = m.d) AS valid, any_value(m.d) AS target_dim,
   count(*) FILTER ({_USABLE} AND len(vector) <> m.d) AS wrong_size
  FROM fx_dirty_vectors v LEFT JOIN modal m ON m.repo = v.repo GROUP BY v.repo""", ("fx_dirty_vectors",), ctes=_MODAL)
def _(t):
    return embed.coverage(t("fx_dirty_vectors"))


@query("emb6_size_histogram", f"""SELECT repo, len(vector) AS dim, count(*) AS n FROM fx_dirty_vectors WHERE {_USABLE}
   GROUP BY repo, len(vector)""", ("fx_dirty_vectors",))
def _(t):
    return embed.size_histogram(t("fx_dirty_vectors"))


def _store(t):
    """Vectors already stored: those of the labelled documents' texts."""
    known = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return known.select(embed.text_hash(F.col("text")).alias("text_hash"), F.lit("m1").alias("model")).dropDuplicates()


@query("emb7_missing_only", """SELECT DISTINCT sha256(text) AS text_hash, 'm1' AS model, CASE WHEN trim(text) = '' THEN 64 ELSE 64 END AS dim
   FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def _(t):
    new = embed.embed_missing(t("documents").select("doc_id", "text"), _store(t), "m1", _hash64, id="doc_id")
    return new.select("text_hash", "model", F.size("vector").alias("dim"))


@query("emb8_query_embed", """SELECT conv_id, 64 AS dim, NULL::VARCHAR AS error FROM (SELECT DISTINCT conv_id FROM conversations)""")
def _(t):
    q = converse.request_state(t("fx_messages")).select("conv_id", "query")
    return embed.embed(q, _hash64, text="query").select("conv_id", F.size("vector").alias("dim"), "error")


@query("emb8_single_text", """SELECT conv_id, turn, CASE WHEN n = 1 THEN 64 END AS dim, CASE WHEN n = 1 THEN CASE WHEN trim(text, chr(32)||chr(9)||chr(10)||chr(13)) = ''
   THEN 0.0 ELSE 1.0 END END::DOUBLE AS norm, CASE WHEN n <> 1 THEN 'only a single text can be embedded as a query' END AS error
  FROM (SELECT conv_id, turn, text, (conv_id + turn) % 3 AS n FROM conversations)""")
def _(t):
    """Queries that come as lists of no, one or two texts; only those of one are sent."""
    n = (F.col("conv_id") + F.col("turn")) % 3
    given = F.slice(F.array("text", "text"), F.lit(1), n.cast("int"))
    asked = t("conversations").select("conv_id", "turn", embed.single_text(given).alias("one")).select("conv_id", "turn", "one.*")
    sent = embed.embed(asked.where("error IS NULL").select("conv_id", "turn", "query"), _hash64, text="query")
    done = sent.select("conv_id", "turn", F.size("vector").alias("dim"), _norm().alias("norm"), "error")
    refused = asked.where("error IS NOT NULL").select("conv_id", "turn", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("double").alias("norm"), "error")
    return done.unionByName(refused)


# --- retrieval: every conversation searches all chunks of its repository -------------------------------------------

_HITS = """scored AS (SELECT q.query_id, c.chunk_id, c.file_path, c.text,
   round(list_inner_product(q.vector::DOUBLE[], c.vector::DOUBLE[]), 6) AS score
  FROM fx_queries q JOIN fx_chunk_vectors c ON c.repo = q.repo),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
 hits AS (SELECT * FROM ranked WHERE rank <= 20)"""
_CONTEXT = """parts AS (SELECT query_id, file_path, min(rank) AS first_rank, concat('## File Path: ', file_path, chr(10), chr(10),
   string_agg(text, chr(10)||chr(10) ORDER BY rank)) AS part FROM hits GROUP BY query_id, file_path)"""
_FX = ("fx_queries", "fx_chunk_vectors")


def hits(t):
    return flagship.hits(t("fx_queries"), t("fx_chunk_vectors"), texts=t("fx_chunks"))


@query("ret1_topk", "SELECT query_id, chunk_id, score, rank FROM hits", _FX, ctes=_HITS)
def _(t):
    return retrieve.search(t("fx_queries"), t("fx_chunk_vectors"))


@query("ret1_topk_blocks", "SELECT query_id, chunk_id, score, rank FROM hits", _FX, ctes=_HITS)
def _(t):
    """The form for more queries than may be broadcast."""
    return retrieve.search(t("fx_queries"), t("fx_chunk_vectors"), broadcast_queries=False, chunk_block=500, query_block=64)


@query("ret1_topk_pruned", "SELECT query_id, chunk_id, score, rank FROM hits", _FX, ctes=_HITS)
def _(t):
    """Blocks whose bound is below a query's k-th score stay unread."""
    marked = cut_lineage(blocks.mark_blocks(t("fx_chunk_vectors").select("chunk_id", "repo", "vector")))
    return blocks.search_pruned(t("fx_queries"), marked, blocks.block_stats(marked))


def _table(t, name: str) -> tuple[str, str, int]:
    """Name, folder and buckets of a new table of this run."""
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return f"{name}_{uuid.uuid4().hex}", scratch_dir(t.spark, name), n


@query("ret1_topk_packed", "SELECT query_id, chunk_id, score, rank FROM hits", _FX, ctes=_HITS)
def _(t):
    """Any number of queries over stored packs of vectors, which are not shuffled."""
    name, path, n = _table(t, "packs")
    return packs.search(t("fx_queries"), packs.write_packs(t("fx_chunk_vectors"), name, path, n))


@query("ret2_hydrate_stored", "SELECT query_id, rank, chunk_id, file_path, text FROM hits", _FX, ctes=_HITS)
def _(t):
    """The hits move to the chunks, which are stored in buckets of their id."""
    name, path, n = _table(t, "texts")
    texts = t("fx_chunk_vectors").select("chunk_id", "file_path", "text")
    stored = colocated.write(texts, name, path, ["chunk_id"], n)
    found = retrieve.search(t("fx_queries"), t("fx_chunk_vectors"))
    return retrieve.hydrate(found, stored).select("query_id", "rank", "chunk_id", "file_path", "text")


@query("ret2_hydrate", "SELECT query_id, rank, chunk_id, file_path, text FROM hits", _FX, ctes=_HITS)
def _(t):
    return hits(t).select("query_id", "rank", "chunk_id", "file_path", "text")


@query("ret3_focus_query", """SELECT r.conv_id, CASE WHEN r.file_path IS NOT NULL THEN concat('Contexts related to ', r.file_path)
   ELSE m.text END AS rag_query FROM fx_requests r JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) m
   USING (conv_id)""", ("fx_requests",))
def _(t):
    last = t("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q"))
    return t("fx_requests").join(last, "conv_id").select(
        "conv_id", retrieve.focus_query(F.col("file_path"), F.col("q")).alias("rag_query")
    )


@query("ret4_group_by_file", "SELECT * FROM parts", _FX, ctes=_HITS + ", " + _CONTEXT)
def _(t):
    return retrieve.group_by_file(hits(t))


@query("ret5_context_text", """SELECT query_id, concat(chr(10), chr(10), '----------', string_agg(part, chr(10)||chr(10) ORDER BY first_rank))
   AS context FROM parts GROUP BY query_id""", _FX, ctes=_HITS + ", " + _CONTEXT)
def _(t):
    return retrieve.context_text(hits(t))


@query("ret6_retrieval_gate", """SELECT d.doc_id, length(text)//4 AS tokens, length(text)//4 > 8000 AS skipped,
   CASE WHEN length(text)//4 <= 8000 AND h.query_id IS NOT NULL THEN 'context' ELSE 'no_context' END AS branch
  FROM documents d LEFT JOIN (SELECT DISTINCT query_id FROM hits) h ON h.query_id = d.doc_id""", _FX, ctes=_HITS)
def _(t):
    req = t("documents").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens")).withColumn(
        "skipped", retrieve.too_large(F.col("tokens"))
    )
    asked = req.where(~F.col("skipped")).select(F.col("doc_id").alias("query_id"))
    found = retrieve.search(t("fx_queries").join(asked, "query_id", "left_semi"), t("fx_chunk_vectors"), k=1)
    with_hits = found.select(F.col("query_id").alias("doc_id"), F.lit(True).alias("_hit"))
    branch = F.when(F.col("_hit"), "context").otherwise("no_context")
    return req.join(with_hits, "doc_id", "left").select("doc_id", "tokens", "skipped", branch.alias("branch"))


@query("ret7_file_content", """SELECT r.conv_id, coalesce(f.text, '') AS file_content FROM fx_requests r
   LEFT JOIN fx_files f ON f.repo = r.repo AND f.file_path = r.file_path""", ("fx_requests",))
def _(t):
    return corpus.file_for_requests(t("fx_requests").select("conv_id", "repo", "file_path"), t("fx_files")).select(
        "conv_id", "file_content"
    )


@query("cnv11_numbered_context", """SELECT query_id, string_agg(concat(rank, '.', chr(10), 'File Path: ', file_path, chr(10), 'Content: ',
   text, chr(10)), '' ORDER BY rank) AS context FROM hits GROUP BY query_id""", _FX, ctes=_HITS)
def _(t):
    return retrieve.numbered_context(hits(t))


_KEPT = f"""kept AS (SELECT doc_id FROM fx_files WHERE NOT list_has_any(string_split(file_path, '/'),
   list_transform({sql_list(C.EXCLUDED_DIRS)}, lambda d: regexp_replace(d, '^[./]+|[./]+$', '', 'g')))
   AND string_split(file_path, '/')[-1] NOT IN {sql_in(C.EXCLUDED_FILES)})"""


@query("flagship_contexts", """SELECT query_id, concat(chr(10), chr(10), '----------', string_agg(part, chr(10)||chr(10) ORDER BY first_rank))
   AS context FROM parts GROUP BY query_id""", _FX,
       ctes=_KEPT + ", " + _HITS.replace("c.repo = q.repo", "c.repo = q.repo JOIN kept k ON k.doc_id = c.doc_id") + ", " + _CONTEXT)
def _(t):
    return flagship.contexts(t.spark, t.sf_dir)
