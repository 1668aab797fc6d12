"""The three whole jobs: index repositories, answer requests, write wikis. Each works on all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.functions import text as X
from repolore.functions import urls
from repolore.operators import converse, corpus, embed, generate, retrieve, wiki
from repolore.plans import flagship
from repolore.session import cut_lineage, scratch_dir
from repolore.sources import stores


def build_index(files: DataFrame, chunk_path: str, embedding_path: str, model: str, make_embedder, **filters) -> DataFrame:
    """Files (repo, doc_id, file_path, text) to stored chunks with vectors; returns the repositories left without any.

    Only texts the embedding store does not know are embedded. Chunks are made once and stored with their text's hash below
    the shared checkpoint folder; what follows reads hashes and sizes, and texts and vectors only where they are written.
    """
    spark = files.sparkSession
    staged = scratch_dir(spark, "index-chunks")
    made = corpus.chunk_words(corpus.to_documents(files, **filters)).withColumn("chunk_id", corpus.chunk_id())
    made.withColumn("text_hash", embed.text_hash(F.col("text"))).write.parquet(staged)
    chunks = spark.read.parquet(staged)
    known = stores.read_embeddings(spark, embedding_path)
    stores.append_embeddings(embed.embed_missing(chunks, known, model, make_embedder), embedding_path)
    stored = embed.stored_vectors(chunks, stores.read_embeddings(spark, embedding_path), model)
    sized = chunks.select("repo", "chunk_id", "text_hash").join(stored.select("text_hash", "dim"), "text_hash", "left")
    vectors = chunks.join(stored.drop("dim"), "text_hash", "left").drop("text_hash")
    stores.write_chunks(embed.keep_dim(vectors, embed.modal_dims(sized, size=F.col("dim"))), chunk_path)
    return embed.repos_without_vectors(sized, F.col("dim"))


def prompts(requests: DataFrame, messages: DataFrame, files: DataFrame, vectors: DataFrame, make_embedder) -> DataFrame:
    """Every request with its state, context and both prompt forms; rejected ones carry ``error_code`` and no prompt.

    ``requests``: conv_id, repo, repo_url, type, provider, language, file_path. Too long questions skip the search.
    """
    state = converse.request_state(messages).drop("error_code")
    checked = converse.validate(requests, state).join(
        state.select("conv_id", "query", "phase", "iteration", "last_content"), "conv_id", "left"
    )
    valid = F.col("error_code").isNull()
    asked = checked.where(valid & ~retrieve.too_large(X.approx_tokens(F.col("last_content")))).select(
        F.col("conv_id").alias("query_id"), "repo", retrieve.focus_query(F.col("file_path"), F.col("query")).alias("q")
    )
    queries = cut_lineage(embed.embed(asked, make_embedder, text="q").where("error IS NULL").select("query_id", "repo", "vector"))
    context = retrieve.context_text(flagship.hits(queries, vectors)).withColumnRenamed("query_id", "conv_id")
    history = converse.render_history(converse.pair_turns(messages)).select(
        "conv_id", "history", F.col("error").alias("history_error")
    )
    full = (
        corpus.file_for_requests(checked, files)
        .join(history, "conv_id", "left")
        .join(context, "conv_id", "left")
        .withColumn("error_code", F.coalesce("error_code", F.when(F.col("history_error").isNotNull(), F.lit(413).cast("bigint"))))
        .withColumn("error", F.coalesce("error", "history_error"))
        .withColumn(
            "system",
            converse.system_prompt(
                F.col("phase"), F.col("type"), F.col("repo_url"), urls.language_name(F.col("language")), F.col("iteration")
            ),
        )
    )
    c = F.col
    parts = (c("system"), c("history"), c("file_path"), c("file_content"))
    return full.select(
        "conv_id", "error_code", F.col("error").alias("rejected"), "iteration",
        F.when(valid, converse.full_prompt(*parts, c("context"), c("query"), c("provider"))).alias("prompt"),
        F.when(valid, converse.simplified_prompt(*parts, c("query"), c("provider"))).alias("short_prompt"),
    )


def answer_requests(
    requests: DataFrame, messages: DataFrame, files: DataFrame, vectors: DataFrame, make_embedder, make_generator
) -> DataFrame:
    """(conv_id, error_code, response): answers, error texts, or the reason a request was rejected."""
    ready = prompts(requests, messages, files, vectors, make_embedder)
    first = cut_lineage(generate.generate(ready.where("error_code IS NULL"), make_generator))
    done = generate.redrive(first, F.col("short_prompt"), make_generator)
    shown = generate.reply_or_message(F.col("response"), F.col("error"))
    rejected = ready.where("error_code IS NOT NULL")
    return done.select("conv_id", "error_code", shown.alias("response")).unionByName(
        rejected.select("conv_id", "error_code", F.col("rejected").alias("response"))
    )


def write_wikis(files: DataFrame, repos: DataFrame, make_planner, make_writer) -> tuple[DataFrame, DataFrame]:
    """(pages, sections) of all repositories. ``repos``: repo, type, repo_url, branch.

    A planner answers with the XML plan; a writer answers per page. Failed pages keep their error as content, and so does
    the one page ``plan`` of a repository that got no plan.
    """
    asked = converse.structure_prompt(repos.select("repo"), corpus.list_tree(files), corpus.pick_readme(files))
    planned = cut_lineage(generate.generate(asked, make_planner).withColumnRenamed("repo", "wiki_id"))
    plan = wiki.parse_xml(planned.where("error IS NULL").select("wiki_id", "response"))
    pages = wiki.page_rows(plan).join(repos.withColumnRenamed("repo", "wiki_id"), "wiki_id")
    links = converse.file_list_markup(
        F.col("file_paths"), lambda p: urls.file_link(F.col("type"), F.col("repo_url"), F.col("branch"), p)
    )
    written = generate.generate(pages.withColumn("prompt", converse.page_prompt(F.col("title"), links)), make_writer)
    text = X.strip_fences(F.col("response"), ["markdown"])
    content = wiki.content_or_failure(text, F.col("error")).alias("content")
    done = cut_lineage(
        written.select("wiki_id", "pos", "id", "title", "importance", "file_paths", "related", content)
    )
    why = F.coalesce("tree_error", "error")
    failed = planned.where("error IS NOT NULL").select(
        "wiki_id", F.lit(0).cast("bigint").alias("pos"), F.lit("plan").alias("id"), F.lit("Wiki plan").alias("title"),
        wiki.content_or_failure(F.lit(None).cast("string"), why).alias("content"),
    )
    return done.unionByName(failed, allowMissingColumns=True), wiki.section_rows(plan)
