"""Documents for readers. A document is a table of ordered parts first, so no wiki has to fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.operators.ordered import whole_texts
from repolore.operators.wiki import related_titles


def markdown_parts(wikis: DataFrame, pages: DataFrame, generated_at: str) -> DataFrame:
    """(wiki_id, block, pos, text) in reading order. Every text ends with a line feed."""
    header = F.concat(
        F.lit("# Wiki Documentation for "), F.col("repo_url"),
        F.lit(f"\n\nGenerated on: {generated_at}\n\n## Table of Contents\n\n"),
    )
    links = (
        related_titles(pages)
        .withColumn("_l", F.concat(F.lit("["), F.col("related_title"), F.lit("](#"), F.col("related_id"), F.lit(")")))
        .groupBy("wiki_id", "id")
        .agg(F.array_sort(F.collect_list(F.struct("rel_pos", "_l"))).alias("_ls"))
        .select("wiki_id", "id", F.array_join(F.transform("_ls", lambda x: x["_l"]), ", ").alias("links"))
    )
    asked = F.coalesce(F.size("related"), F.lit(0)) > 0
    related = F.when(
        asked,
        F.concat(
            F.lit("### Related Pages\n\n"),
            F.when(F.col("links").isNotNull(), F.concat(F.lit("Related topics: "), F.col("links"), F.lit("\n\n"))).otherwise(""),
        ),
    ).otherwise("")
    page = F.concat(
        F.lit("<a id='"), F.col("id"), F.lit("'></a>\n\n## "), F.col("title"), F.lit("\n\n"), related,
        F.coalesce("content", F.lit("")), F.lit("\n\n---\n\n"),
    )

    def rows(df: DataFrame, block: int, pos: Column, text: Column) -> DataFrame:
        return df.select(
            "wiki_id", F.lit(block).cast("bigint").alias("block"), pos.cast("bigint").alias("pos"), text.alias("text")
        )

    toc = F.concat(F.lit("- ["), F.col("title"), F.lit("](#"), F.col("id"), F.lit(")\n"))
    zero = F.lit(0)
    return (
        rows(wikis, 0, zero, header)
        .unionByName(rows(pages, 1, F.col("pos"), toc))
        .unionByName(rows(wikis, 2, zero, F.lit("\n")))
        .unionByName(rows(pages.join(links, ["wiki_id", "id"], "left"), 3, F.col("pos"), page))
    )


def write_parts(parts: DataFrame, path: str) -> None:
    """Text files per wiki: reading a wiki's files by name gives its document, however many tasks wrote it."""
    order = ["wiki_id", "block", "pos"]
    (
        parts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("wiki_id", F.expr("left(text, length(text) - 1)").alias("value"))  # the writer adds the line feed
        .write.mode("overwrite")
        .partitionBy("wiki_id")
        .text(path)
    )


def read_parts(spark: SparkSession, path: str, **kw) -> DataFrame:
    """(wiki_id, block, document): what ``write_parts`` wrote, as blocks (``whole_texts``). A file is one task's share, so it fits a cell."""
    files = spark.read.schema("value string, wiki_id string").text(path, wholetext=True)
    named = files.select("wiki_id", "value", F.col("_metadata.file_name").alias("name"))
    return whole_texts(named, ["wiki_id"], ["name"], "value", out="document", **kw)


def json_documents(wikis: DataFrame, pages: DataFrame, generated_at: str, **kw) -> DataFrame:
    """(wiki_id, block, document): metadata and pages of each wiki that has pages, as blocks of one JSON text (``whole_texts``)."""
    page = F.to_json(
        F.struct("id", "title", "content", F.col("file_paths").alias("filePaths"), "importance", F.col("related").alias("relatedPages"))
    )
    counts = pages.groupBy("wiki_id").agg(F.count("*").alias("page_count"), F.min("pos").alias("_first"))
    meta = F.to_json(
        F.struct(
            F.struct(F.col("repo_url").alias("repository"), F.lit(generated_at).alias("generated_at"), "page_count").alias("metadata")
        )
    )
    at = F.lit(0).cast("bigint").alias("pos")
    ends = wikis.join(counts, "wiki_id").withColumn("_meta", meta).select("wiki_id", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), at, F.concat(F.expr("left(_meta, length(_meta) - 1)"), F.lit(',"pages":[')).alias("part")),
        F.struct(F.lit(2).alias("section"), at, F.lit("]}").alias("part")),
    )))
    known = counts.join(wikis.select("wiki_id").distinct(), "wiki_id", "left_semi")
    rows = pages.join(known, "wiki_id").select(
        "wiki_id", F.lit(1).alias("section"), F.col("pos").cast("bigint").alias("pos"),
        F.concat(F.when(F.col("pos") > F.col("_first"), ",").otherwise(""), page).alias("part"),
    )
    return whole_texts(ends.unionByName(rows), ["wiki_id"], ["section", "pos"], "part", out="document", **kw)


def file_name(repo_url: Column, stamp: str, extension: str) -> Column:
    last = F.element_at(F.split(F.regexp_replace(repo_url, r"/+$", ""), "/"), -1)
    return F.concat(last, F.lit(f"_wiki_{stamp}.{extension}"))


def slide_decks(slides: DataFrame, language: str = "en", **kw) -> DataFrame:
    """(deck_id, k, html) to (deck_id, block, document): one HTML text per deck, as blocks (``whole_texts``)."""
    box = F.concat(F.lit('<div class="slide-container">'), F.col("html"), F.lit("</div>\n"))
    boxes = slides.select("deck_id", F.lit(1).alias("section"), F.col("k").cast("bigint").alias("k"), box.alias("part"))
    at = F.lit(0).cast("bigint").alias("k")
    ends = slides.select("deck_id").distinct().select("deck_id", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), at, F.lit(f'<!DOCTYPE html>\n<html lang="{language}">\n<body>\n').alias("part")),
        F.struct(F.lit(2).alias("section"), at, F.lit("</body>\n</html>\n").alias("part")),
    )))
    return whole_texts(ends.unionByName(boxes), ["deck_id"], ["section", "k"], "part", out="document", **kw)


def write_documents(docs: DataFrame, key: str, text: str, path: str) -> None:
    """One partition folder per document; for answers, workshops and decks."""
    docs.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
