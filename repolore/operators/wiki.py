"""Wiki plans: XML to tables, links, sections, navigation tree, progress. Keyed by ``wiki_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import text as X
from repolore.operators.ordered import top_n
from repolore.session import cut_lineage, keep_small

XML_SCHEMA = """
title string, description string,
sections struct<section: array<struct<_id: string, title: string, pages: struct<page_ref: array<string>>,
                                      subsections: struct<section_ref: array<string>>>>>,
pages struct<page: array<struct<_id: string, title: string, importance: string,
                                relevant_files: struct<file_path: array<string>>,
                                related_pages: struct<related: array<string>>>>>,
_corrupt_record string
"""


def locate_xml(response: Column) -> Column:
    """The ``<wiki_structure>`` document inside a response without control characters; null when there is none."""
    unfenced = X.strip_fences(response, ["xml", ""])
    return X.drop_control_chars(X.first_match(unfenced, r"(?s)<wiki_structure>.*?</wiki_structure>"))


def repair_xml(xml: Column) -> Column:
    """Escape bare ampersands and tidy ``  >``."""
    escaped = F.regexp_replace(xml, r"&(?!amp;|lt;|gt;|apos;|quot;)", "&amp;")
    return F.replace(escaped, F.lit("  >"), F.lit(">"))


def _given(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")


def _importance(raw: Column) -> Column:
    return F.when(raw.isNull(), "medium").when(raw.isin("high", "medium"), raw).otherwise("low")


def parse_xml(responses: DataFrame) -> DataFrame:
    """(wiki_id, response) to one row per wiki with typed ``pages``/``sections`` arrays and an ``error``.

    Documents the XML reader rejects go through the pattern-based reading in the same pass.
    """
    doc = responses.select("wiki_id", repair_xml(locate_xml(F.col("response"))).alias("xml"))
    parsed = doc.withColumn("x", F.from_xml("xml", XML_SCHEMA, {"mode": "PERMISSIVE"}))
    broken = F.col("x._corrupt_record").isNotNull() | (F.col("x.title").isNull() & F.col("x.pages").isNull())
    pages = F.transform(
        F.coalesce("x.pages.page", F.lit(None)),
        lambda p, i: F.struct(
            F.coalesce(F.nullif(p["_id"], F.lit("")), F.concat(F.lit("page-"), (i + 1).cast("string"))).alias("id"),
            F.coalesce(p["title"], F.lit("")).alias("title"),
            _importance(p["importance"]).alias("importance"),
            _given(p["relevant_files"]["file_path"]).alias("file_paths"),
            _given(p["related_pages"]["related"]).alias("related"),
        ),
    )
    sections = F.transform(
        F.coalesce("x.sections.section", F.lit(None)),
        lambda s, i: F.struct(
            F.coalesce(F.nullif(s["_id"], F.lit("")), F.concat(F.lit("section-"), (i + 1).cast("string"))).alias("id"),
            F.coalesce(s["title"], F.lit("")).alias("title"),
            _given(s["pages"]["page_ref"]).alias("page_refs"),
            _given(s["subsections"]["section_ref"]).alias("section_refs"),
        ),
    )
    fallback = pages_by_pattern(F.col("xml"))
    return parsed.select(
        "wiki_id",
        F.when(F.col("xml").isNull(), "No valid XML found in response").alias("error"),
        (F.col("xml").isNotNull() & broken).alias("by_pattern"),
        F.when(broken, first_text(F.col("xml"), "title")).otherwise(F.coalesce("x.title", F.lit(""))).alias("title"),
        F.when(broken, first_text(F.col("xml"), "description"))
        .otherwise(F.coalesce("x.description", F.lit("")))
        .alias("description"),
        F.when(broken, fallback).otherwise(pages).alias("pages"),
        F.when(~broken, sections).alias("sections"),
    )


def unescape(text: Column) -> Column:
    """The five XML entities back to characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def first_text(xml: Column, tag: str) -> Column:
    """Trimmed text of the first ``tag`` element, by pattern."""
    return unescape(X.strip(F.regexp_extract(xml, f"(?s)<{tag}>(.*?)</{tag}>", 1)))


def all_texts(xml: Column, tag: str) -> Column:
    found = F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda t: unescape(X.strip(t)))


def pages_by_pattern(xml: Column) -> Column:
    """Pages of a document that is no valid XML, element by element."""
    page = F.lit(r'(?s)<page id="(.*?)">(.*?)</page>')
    found = F.arrays_zip(
        F.regexp_extract_all(xml, page, F.lit(1)).alias("id"), F.regexp_extract_all(xml, page, F.lit(2)).alias("body")
    )
    return F.transform(
        found,
        lambda p: F.struct(
            p["id"].alias("id"),
            first_text(p["body"], "title").alias("title"),
            _importance(F.nullif(first_text(p["body"], "importance"), F.lit(""))).alias("importance"),
            _given(all_texts(p["body"], "file_path")).alias("file_paths"),
            _given(all_texts(p["body"], "related")).alias("related"),
        ),
    )


def page_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("wiki_id", F.posexplode("pages").alias("pos", "p")).select(
        "wiki_id", F.col("pos").cast("bigint").alias("pos"), "p.id", "p.title", "p.importance", "p.file_paths",
        "p.related",
    )


def section_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("wiki_id", F.posexplode("sections").alias("pos", "s")).select(
        "wiki_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.id").alias("section_id"), "s.title",
        F.col("s.page_refs").alias("page_ids"), F.col("s.section_refs").alias("child_ids"),
    )


# --- links -----------------------------------------------------------------------------------------------------


def with_content(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Pages with their generated text, or the fixed note when there is none."""
    g = generated.select("wiki_id", "id", F.col("content").alias("_c"))
    return (
        pages.join(g, ["wiki_id", "id"], "left")
        .withColumn("content", F.coalesce(F.nullif("_c", F.lit("")), F.lit(C.MISSING_CONTENT)))
        .drop("_c")
    )


def related_titles(pages: DataFrame) -> DataFrame:
    """(wiki_id, id, rel_pos, related_id, related_title); links to unknown pages are dropped."""
    links = pages.select("wiki_id", "id", F.posexplode("related").alias("rel_pos", "related_id"))
    names = pages.select("wiki_id", F.col("id").alias("related_id"), F.col("title").alias("related_title"))
    return links.join(names, ["wiki_id", "related_id"]).select(
        "wiki_id", "id", F.col("rel_pos").cast("bigint").alias("rel_pos"), "related_id", "related_title"
    )


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    refs = sections.select("wiki_id", "section_id", F.posexplode("page_ids").alias("pos", "id"))
    return refs.join(pages.select("wiki_id", "id", "title"), ["wiki_id", "id"]).select(
        "wiki_id", "section_id", F.col("pos").cast("bigint").alias("pos"), "id", "title"
    )


def root_sections(sections: DataFrame) -> DataFrame:
    """Sections no section points at."""
    children = sections.select("wiki_id", F.explode("child_ids").alias("section_id"))
    return sections.select("wiki_id", "section_id", "pos").join(children, ["wiki_id", "section_id"], "left_anti")


def section_tree(sections: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sections as shown from the roots down: depth and path. A section is not entered twice on one path, so cycles
    end. One join per level; each level is checkpointed, so the plan does not grow with the depth."""
    known = sections.select("wiki_id", "section_id")
    edges = (
        sections.select("wiki_id", F.col("section_id").alias("parent_id"), F.explode("child_ids").alias("section_id"))
        .join(known, ["wiki_id", "section_id"])
        .select("wiki_id", "parent_id", F.col("section_id").alias("child_id"))
    )
    level = cut_lineage(
        roots.join(known, ["wiki_id", "section_id"]).select(
            "wiki_id", "section_id", F.lit(0).cast("bigint").alias("depth"), F.array("section_id").alias("path")
        )
    )
    levels = [level]
    while max_depth is None or len(levels) <= max_depth:
        level = cut_lineage(
            level.withColumnRenamed("section_id", "parent_id")
            .join(edges, ["wiki_id", "parent_id"])
            .where(~F.array_contains("path", F.col("child_id")))
            .select(
                "wiki_id", F.col("child_id").alias("section_id"), (F.col("depth") + 1).alias("depth"),
                F.concat("path", F.array("child_id")).alias("path"),
            )
        )
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


_ITEM = ["wiki_id", "parent_id", "k", "id", "kind", "depth", "own"]


def _outline_levels(sections: DataFrame, pages_in: DataFrame, roots: DataFrame, max_depth: int) -> list[DataFrame]:
    """Per depth the sections and references (``_ITEM``); ``own``: places the row itself and its pages take."""
    known = cut_lineage(
        sections.select("wiki_id", F.col("section_id").alias("id"), F.col("pos").alias("_pos"))
        .join(pages_in.groupBy("wiki_id", F.col("section_id").alias("id")).agg(F.count("*").alias("_n")), ["wiki_id", "id"], "left")
        .select("wiki_id", "id", "_pos", (1 + F.coalesce("_n", F.lit(0))).alias("_own"))
    )
    child = sections.select("wiki_id", F.col("section_id").alias("parent_id"), F.posexplode("child_ids").alias("k", "id"))
    edges = cut_lineage(child.withColumn("k", F.col("k").cast("bigint")).join(known, ["wiki_id", "id"]))
    at = roots.select("wiki_id", F.col("section_id").alias("id")).distinct().join(known, ["wiki_id", "id"])
    zero = F.lit(0).cast("bigint")
    level = cut_lineage(at.select(
        "wiki_id", F.lit(None).cast("string").alias("parent_id"), F.col("_pos").alias("k"), "id", F.lit("section").alias("kind"),
        zero.alias("depth"), F.col("_own").alias("own"), "_pos",
    ))
    levels, seen = [level], level.select("wiki_id", "id")
    while not level.isEmpty():
        parents = level.where("kind = 'section'").select("wiki_id", F.col("id").alias("parent_id"), F.col("_pos").alias("_parent_pos"))
        if len(levels) > max_depth:  # what lies deeper is named, not entered
            deep = edges.join(parents, ["wiki_id", "parent_id"])
            levels.append(cut_lineage(deep.select(
                "wiki_id", "parent_id", "k", "id", F.lit("error").alias("kind"), F.lit(len(levels)).cast("bigint").alias("depth"),
                F.lit(1).cast("bigint").alias("own"), "_pos",
            )))
            break
        found = edges.join(parents, ["wiki_id", "parent_id"])
        first = (
            found.join(seen, ["wiki_id", "id"], "left_anti").groupBy("wiki_id", "id")
            .agg(F.min(F.struct("_parent_pos", "parent_id", "k")).alias("_first"))
        )
        enters = F.coalesce(F.col("_first") == F.struct("_parent_pos", "parent_id", "k"), F.lit(False))
        level = cut_lineage(found.join(first, ["wiki_id", "id"], "left").select(
            "wiki_id", "parent_id", "k", "id", F.when(enters, "section").otherwise("reference").alias("kind"),
            F.lit(len(levels)).cast("bigint").alias("depth"), F.when(enters, F.col("_own")).otherwise(1).cast("bigint").alias("own"), "_pos",
        ))
        levels.append(level)
        seen = seen.unionByName(level.where("kind = 'section'").select("wiki_id", "id"))
    return [x.select(*_ITEM) for x in levels]


def section_outline(sections: DataFrame, pages: DataFrame, roots: DataFrame, max_depth: int = 100) -> DataFrame:
    """The whole navigation in display order, as nested sets: (wiki_id, entry, exit, kind, id, parent_id, depth, error).

    ``entry`` numbers the rows of a wiki from 0 as they are read: a section, its pages, its subsections; ``exit`` is the
    last entry inside. A section is entered once, at its least deep place (ties: the parent first in the plan, then
    by list position); its other places are rows of kind ``reference``, so the outline has one row per link however
    many paths there are, and cycles end. Sections below ``max_depth`` are rows of kind ``error``. Links to unknown
    sections and pages are dropped, as are sections that no root leads to. One join per level down, up and down
    again over narrow rows; section ids and positions are unique in a wiki.
    """
    refs = sections.select("wiki_id", "section_id", F.posexplode("page_ids").alias("j", "id"))
    pages_in = cut_lineage(refs.join(pages.select("wiki_id", "id").distinct(), ["wiki_id", "id"], "left_semi"))
    levels = _outline_levels(sections, pages_in, roots, max_depth)

    sized, below = [], None
    for level in reversed(levels):  # up: places that a row takes with all inside
        if below is None:
            level = level.withColumn("size", F.col("own"))
        else:
            inside = below.groupBy("wiki_id", F.col("parent_id").alias("id")).agg(F.sum("size").alias("_in"))
            inside = inside.withColumn("kind", F.lit("section"))
            level = level.join(inside, ["wiki_id", "id", "kind"], "left").select(
                *_ITEM, (F.col("own") + F.coalesce("_in", F.lit(0))).alias("size")
            )
        below = cut_lineage(level)
        sized.insert(0, below)

    placed, above = [], None
    for level in sized:  # down: after the parent, its pages and the rows before
        before = Window.partitionBy("wiki_id", "parent_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        if above is None:
            level = level.withColumn("entry", F.col("_before"))
        else:
            start = above.where("kind = 'section'").select("wiki_id", F.col("id").alias("parent_id"), (F.col("entry") + F.col("own")).alias("_start"))
            level = level.join(start, ["wiki_id", "parent_id"]).withColumn("entry", F.col("_start") + F.col("_before"))
        above = cut_lineage(level.select(*_ITEM, "size", "entry"))
        placed.append(above)
    rows = reduce(DataFrame.unionByName, placed)
    error = F.when(F.col("kind") == "error", F.lit(f"nested deeper than {max_depth} levels"))
    items = rows.select(
        "wiki_id", "entry", (F.col("entry") + F.col("size") - 1).alias("exit"), "kind", "id", "parent_id", "depth", error.alias("error")
    )
    nth = F.row_number().over(Window.partitionBy("wiki_id", "section_id").orderBy("j"))
    owner = rows.where("kind = 'section'").select("wiki_id", F.col("id").alias("section_id"), "entry", "depth")
    leaves = pages_in.withColumn("_nth", nth).join(owner, ["wiki_id", "section_id"]).select(
        "wiki_id", (F.col("entry") + F.col("_nth")).alias("entry"), (F.col("entry") + F.col("_nth")).alias("exit"), F.lit("page").alias("kind"),
        "id", F.col("section_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("error"),
    )
    return items.unionByName(leaves)


def navigation(wikis: DataFrame, tree: DataFrame, pages: DataFrame) -> DataFrame:
    """Section rows where a wiki has any, else its pages as a flat list. Ids are kept before they meet the pages, whose
    hot wikis AQE can then split."""
    with_tree = tree.select("wiki_id").distinct()
    without = keep_small(wikis.select("wiki_id").join(with_tree, "wiki_id", "left_anti"))
    flat = (
        without.join(pages, "wiki_id")
        .select("wiki_id", F.lit("page").alias("kind"), F.col("id").alias("item"), F.lit(0).cast("bigint").alias("depth"))
    )
    return tree.select("wiki_id", F.lit("section").alias("kind"), F.col("section_id").alias("item"), "depth").unionByName(
        flat
    )


# --- sections made up when the plan has none -------------------------------------------------------------------------


def title_category(title: Column) -> Column:
    """First category (in list order) with a keyword inside the lower-cased title. Substrings count."""
    low = F.lower(title)
    chain = F.when(F.lit(False), "")
    for cid, _, words in C.CATEGORIES:
        chain = chain.when(X.contains_any(low, words), cid)
    return chain.otherwise(C.OTHER_CATEGORY[0])


def _labels(col: Column, pairs: list[tuple]) -> Column:
    chain = F.when(F.lit(False), F.lit(None))
    for key, value in pairs:
        chain = chain.when(col == key, F.lit(value))
    return chain


def sections_by_title(pages: DataFrame) -> DataFrame:
    """Page rows with their made-up section; section order is the category order."""
    cats = [(c, t) for c, t, _ in C.CATEGORIES] + [C.OTHER_CATEGORY]
    cat = F.col("_cat")
    return (
        pages.withColumn("_cat", title_category(F.col("title")))
        .select(
            "wiki_id", F.concat(F.lit("section-"), cat).alias("section_id"), _labels(cat, cats).alias("section_title"),
            _labels(cat, [(c, i) for i, (c, _) in enumerate(cats)]).cast("bigint").alias("section_pos"),
            "pos", "id",
        )
    )


def sections_by_importance(pages: DataFrame) -> DataFrame:
    imp = F.col("importance")
    rows = C.IMPORTANCE_SECTIONS
    return pages.where(imp.isin([i for i, _, _ in rows])).select(
        "wiki_id", _labels(imp, [(i, s) for i, s, _ in rows]).alias("section_id"),
        _labels(imp, [(i, t) for i, _, t in rows]).alias("section_title"),
        _labels(imp, [(i, n) for n, (i, _, _) in enumerate(rows)]).cast("bigint").alias("section_pos"),
        "pos", "id",
    )


# --- generation progress ---------------------------------------------------------------------------------------------


def pending_pages(pages: DataFrame, generated: DataFrame, in_flight: DataFrame) -> DataFrame:
    done = generated.where(F.coalesce("content", F.lit("")) != "").select("wiki_id", "id")
    busy = in_flight.select("wiki_id", "id")
    return (
        pages.select("wiki_id", "pos", "id")
        .join(done, ["wiki_id", "id"], "left_anti")
        .join(busy, ["wiki_id", "id"], "left_anti")
    )


def progress(pages: DataFrame, in_flight: DataFrame, shown: int = 3) -> DataFrame:
    """Finished count and a label with the first pages in work. ``in_flight``: (wiki_id, id, seq)."""
    totals = pages.groupBy("wiki_id").agg(F.count("*").alias("total"))
    busy = in_flight.groupBy("wiki_id").agg(F.count("*").alias("busy"))
    names = (
        top_n(in_flight, ["wiki_id"], ["seq"], shown)
        .join(pages.select("wiki_id", "id", "title"), ["wiki_id", "id"])
        .groupBy("wiki_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("_n"))
        .select("wiki_id", F.array_join(F.transform("_n", lambda n: n["title"]), ", ").alias("names"))
    )
    b = F.coalesce("busy", F.lit(0))
    more = F.when(b > shown, F.concat(F.lit(" +"), (b - shown).cast("string"), F.lit(" more"))).otherwise("")
    return (
        totals.join(busy, "wiki_id", "left").join(names, "wiki_id", "left")
        .select(
            "wiki_id", "total", (F.col("total") - b).alias("done"),
            F.concat(F.coalesce("names", F.lit("")), more).alias("in_progress"),
        )
    )


def completion(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Whether a wiki may be cached: as many generated pages as planned, each with real content."""
    g = generated.select("wiki_id", "id", F.col("content").alias("_c"))
    ok = F.coalesce((F.col("_c") != "") & (F.col("_c") != C.LOADING_CONTENT), F.lit(False))
    planned = pages.select("wiki_id", "id").join(g, ["wiki_id", "id"], "left").groupBy("wiki_id").agg(
        F.count("*").alias("n_pages"), F.bool_and(ok).alias("_all")
    )
    made = generated.groupBy("wiki_id").agg(F.count("*").alias("n_generated"))
    n = F.coalesce("n_generated", F.lit(0))
    return planned.join(made, "wiki_id", "left").select(
        "wiki_id", "n_pages", n.alias("n_generated"), ((n >= F.col("n_pages")) & (n > 0) & F.col("_all")).alias("complete")
    )


def content_or_failure(content: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(F.lit("Error generating content: "), error)).otherwise(content)
