"""Whole jobs over the given tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.operators import converse, embed, generate
from repolore.plans import lifecycle
from repolore.plans.converse_queries import _PAIRS, _SHORT_PROMPT, _STATE, _SYSTEM
from repolore.plans.corpus_queries import _EXCL_DIRS, _EXT, _HIDDEN, _LISTED, _NAME
from repolore.plans.registry import query, sql_in, sql_list
from repolore.session import scratch_dir

_hash64 = partial(embed.HashEmbedder, 64)


@query("job_build_index", f"""SELECT c.repo, c.file_path, c.ord::INTEGER AS ord, c.text, 64 AS dim, true AS own_vector FROM fx_chunks c JOIN fx_files f ON f.doc_id = c.doc_id
   WHERE NOT list_has_any(string_split(f.file_path, '/'), {_EXCL_DIRS}) AND NOT list_contains({sql_list(C.EXCLUDED_FILES)}, {_NAME.replace('file_path', 'f.file_path')})
   AND {_EXT.replace('file_path', 'f.file_path')} IN {sql_in(C.CODE_EXTENSIONS + C.DOC_EXTENSIONS)} AND NOT {_HIDDEN.replace('file_path', 'f.file_path')}
   AND length(f.text)//4 <= CASE WHEN {_EXT.replace('file_path', 'f.file_path')} IN {sql_in(C.CODE_EXTENSIONS)} THEN 81920 ELSE 8192 END""", ("fx_chunks",))
def _(t):
    base = scratch_dir(t.spark, "index")
    lifecycle.build_index(t("fx_files"), f"{base}/chunks", f"{base}/vectors", "m1", _hash64)
    stored = t.spark.read.parquet(f"{base}/chunks")
    again = embed.embed(stored.withColumnRenamed("vector", "stored"), _hash64)  # each text has the vector made of it
    return again.select(
        "repo", "file_path", "ord", "text", F.size("stored").alias("dim"), (F.col("stored") == F.col("vector")).alias("own_vector")
    )


@query("job_answer_requests", """SELECT r.conv_id, CASE WHEN a.last_role <> 'user' THEN 400::BIGINT END AS error_code,
   CASE WHEN a.last_role <> 'user' THEN 'Last message must be from the user' ELSE concat('echo: /no_think ', s.system_prompt) END AS response
  FROM fx_requests r JOIN agg a USING (conv_id) JOIN system s USING (conv_id)""", ("fx_requests", "fx_messages", "fx_chunk_vectors"),
       ctes=_STATE + ", " + _SYSTEM)
def _(t):
    return lifecycle.answer_requests(
        t("fx_requests"), t("fx_messages"), t("fx_files"), t("fx_chunk_vectors"), _hash64, generate.EchoGenerator
    )


@query("job_answer_digests", f"""SELECT p.conv_id, CASE WHEN a.last_role <> 'user' THEN 400::BIGINT END AS error_code,
   CASE WHEN a.last_role <> 'user' THEN 'Last message must be from the user' ELSE sha256(p.prompt) END AS response
  FROM ({_SHORT_PROMPT}) p JOIN agg a USING (conv_id)""", ("fx_requests", "fx_messages", "fx_chunk_vectors"),
       ctes=", ".join([_STATE, _SYSTEM, _PAIRS]))
def _(t):
    """Every full prompt is refused as too long; the answer is the digest of the whole short prompt that follows it."""
    make = partial(generate.DigestGenerator, converse.SIMPLIFIED)
    return lifecycle.answer_requests(
        t("fx_requests"), t("fx_messages"), t("fx_files"), t("fx_chunk_vectors"), _hash64, make
    )


@query("job_write_wikis", f"""SELECT repo AS wiki_id, pos, concat('p', pos) AS id, concat(top, ': ', n, ' files') AS title,
   CASE WHEN pos = 0 THEN 'high' ELSE 'low' END AS importance, [least_path] AS file_paths,
   concat('echo: Write the wiki page ''', top, ': ', n, ' files'' in Markdown.') AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY top) - 1 AS pos FROM (SELECT repo, split_part(file_path, '/', 1) AS top, count(*) AS n,
   min(file_path) AS least_path FROM fx_files WHERE {_LISTED} GROUP BY ALL))""", ("fx_files",))
def _(t):
    """From file trees to plans to written pages."""
    repos = t("fx_files").select("repo").distinct().select(
        "repo", F.lit("github").alias("type"), F.concat(F.lit("https://github.com/o/"), "repo").alias("repo_url"), F.lit("main").alias("branch")
    )
    pages, _ = lifecycle.write_wikis(t("fx_files"), repos, generate.FolderPlanner, generate.EchoGenerator)
    return pages.select("wiki_id", "pos", "id", "title", "importance", "file_paths", "content")
