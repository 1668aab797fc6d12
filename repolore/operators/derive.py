"""Documents made from wikis and responses: packed context, slide plans, contents lists, research stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import text as X
from repolore.operators.ordered import whole_texts
from repolore.session import keep_small

_LINE = r"[^\n\r\x{2028}\x{2029}]"


def summary(content: Column) -> Column:
    """First one-line paragraph after a ``# `` heading."""
    pattern = rf"# {_LINE}*?\n\n({_LINE}*?)(\n\n|\z)"
    return F.when(content.rlike(pattern), X.strip(F.regexp_extract(content, pattern, 1))).otherwise(C.NO_SUMMARY)


def _entry(title: Column, body: Column) -> Column:
    return F.concat(F.lit("## "), title, F.lit("\n"), body, F.lit("\n\n"))


def _reachable(entries: DataFrame, cost: Column, budget: int, block: int = 65_536) -> DataFrame:
    """Entries that the budget can still reach. ``cost`` is the least an entry adds.

    Costs are summed per block of positions, and a block is dropped when those before it already pass the budget. What
    is left per wiki is bounded (about ``budget`` / 6 entries and one block), whatever the size of the wiki.
    """
    blocked = entries.withColumn("_blk", F.floor(F.col("pos") / block))
    before = Window.partitionBy("wiki_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("wiki_id", "_blk").agg(F.sum(cost).alias("_c"))
    keep = sums.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).where(F.col("_b") <= budget)
    return blocked.join(keep.select("wiki_id", "_blk"), ["wiki_id", "_blk"], "left_semi").drop("_blk")


def pack(pages: DataFrame, budget: int = C.PACK_BUDGET) -> DataFrame:
    """Which pages go into a wiki's context of about ``budget`` characters: (wiki_id, phase, pos, used, text).

    Phase 1: important pages in order up to and including the one that passes the budget. Phase 2, when room is left:
    other pages in order, whole if they fit, else as summary, until the budget is passed. Choices are made on lengths;
    texts join in last.
    """
    entries = pages.where(F.coalesce("content", F.lit("")) != "").select(
        "wiki_id", "pos", (F.col("importance") == "high").alias("high"),
        F.length(_entry(F.col("title"), F.col("content"))).alias("full"),
        F.length(_entry(F.col("title"), summary(F.col("content")))).alias("short"),
    )
    before = Window.partitionBy("wiki_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    important = _reachable(entries.where("high"), F.col("full"), budget)
    phase1 = important.withColumn("_b", F.coalesce(F.sum("full").over(before), F.lit(0))).where(F.col("_b") <= budget)
    spent = phase1.groupBy("wiki_id").agg(F.sum("full").alias("spent"))

    others = _reachable(entries.where("NOT high"), F.least("full", "short"), budget)
    gathered = (
        others.groupBy("wiki_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "full", "short"))).alias("items"))
        .join(spent, "wiki_id", "left")
        .withColumn("spent", F.coalesce("spent", F.lit(0)).cast("bigint"))
        .where(F.col("spent") < budget)
    )
    start = F.struct(
        F.col("spent").alias("total"), F.array().cast("array<struct<pos:bigint,used:string>>").alias("picks")
    )

    def step(acc: Column, item: Column) -> Column:
        fits = acc["total"] + item["full"] <= budget
        added = acc["total"] + F.when(fits, item["full"]).otherwise(item["short"])
        pick = F.struct(item["pos"].alias("pos"), F.when(fits, "full").otherwise("summary").alias("used"))
        return F.when(acc["total"] > budget, acc).otherwise(
            F.struct(added.cast("bigint").alias("total"), F.concat(acc["picks"], F.array(pick)).alias("picks"))
        )

    phase2 = gathered.select("wiki_id", F.explode(F.aggregate("items", start, step)["picks"]).alias("p")).select(
        "wiki_id", F.lit(2).cast("bigint").alias("phase"), "p.pos", "p.used"
    )
    chosen = phase1.select(
        "wiki_id", F.lit(1).cast("bigint").alias("phase"), "pos", F.lit("full").alias("used")
    ).unionByName(phase2)
    body = F.when(F.col("used") == "full", F.col("content")).otherwise(summary(F.col("content")))
    return chosen.join(pages.select("wiki_id", "pos", "title", "content"), ["wiki_id", "pos"]).select(
        "wiki_id", "phase", "pos", "used", _entry(F.col("title"), body).alias("text")
    )


# --- slides ----------------------------------------------------------------------------------------------------------


def slide_items(plan: Column, repo: Column) -> Column:
    """Slide lines of a plan: four patterns in turn, else the default deck."""

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(plan, F.lit(pattern.replace("{s}", X.SPACE)), F.lit(1))

    titled = F.filter(
        found(C.SLIDE_TITLED), lambda t: (F.length(t) > 3) & ~X.contains_any(F.lower(t), C.SLIDE_TITLE_BLOCKERS)
    )
    default = F.transform(
        F.array(*[F.lit(t) for t in C.DEFAULT_SLIDES]), lambda t: F.replace(t, F.lit("{repo}"), repo)
    )
    pick = default
    for option in (titled, *map(found, (C.SLIDE_NAMED, C.SLIDE_BRACKETED, C.SLIDE_DOTTED))):
        pick = F.when(F.size(option) > 0, option).otherwise(pick)
    return pick


def title_of(item: Column) -> Column:
    return X.strip(F.get(F.split(item, ":"), F.lit(0)))


def description_of(item: Column) -> Column:
    return F.coalesce(X.strip(F.get(F.split(item, ":"), F.lit(1))), F.lit(""))


def slide_plan(plans: DataFrame) -> DataFrame:
    """(deck_id, repo, plan) to numbered slides ``k of n``; numbers come from the plan's own list, no window."""
    items = plans.select("deck_id", slide_items(F.col("plan"), F.col("repo")).alias("_i"))
    return items.select("deck_id", F.size("_i").cast("bigint").alias("n"), F.posexplode("_i").alias("k", "item")).select(
        "deck_id", (F.col("k") + 1).cast("bigint").alias("k"), "n",
        title_of(F.col("item")).alias("title"), description_of(F.col("item")).alias("description"),
    )


def slide_html(response: Column, title: Column) -> Column:
    """HTML of a slide response: code block, slide element, first element, else the raw text; wrapped if unstyled."""
    s = X.SPACE
    fence = rf"(?s)```(?:html)?[{s}]*(.*?)[{s}]*```"
    div = rf'(?s)<div class="slide".*?</div>[{s}]*</div>'
    tag = F.regexp_extract(F.regexp_extract(response, r"(?s)<.*?>", 0), r"(?i)<([a-z][a-z0-9]*)", 1)
    element = F.call_function(
        "regexp_extract", response, F.concat(F.lit("(?is)<"), tag, F.lit(".*?</"), tag, F.lit(">")), F.lit(0)
    )
    html = (
        F.when(response.rlike(fence), F.regexp_extract(response, fence, 1))
        .when(response.contains('<div class="slide"'), F.regexp_extract(response, div, 0))
        .when(response.contains("<") & response.contains(">") & (tag != ""), element)
    )
    html = F.coalesce(F.nullif(html, F.lit("")), response)
    styled = html.contains("<style>") | html.contains('<link rel="stylesheet"')
    wrapped = F.concat(
        F.lit('<div class="slide"><div class="slide-header">'), title, F.lit('</div><div class="content">'), html,
        F.lit("</div></div>"),
    )
    return F.when(styled, html).otherwise(wrapped)


# --- workshops -------------------------------------------------------------------------------------------------------


def headings(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(?m)^## (.*)$"), F.lit(1))


def contents_list(found: Column) -> Column:
    """Markdown list of the ``## `` headings found, with their links."""
    lines = F.transform(found, lambda h: F.concat(F.lit("- ["), h, F.lit("](#"), X.slug(h), F.lit(")\n")))
    return F.concat(F.lit("## Table of Contents\n\n"), F.array_join(lines, ""), F.lit("\n"))


def insert_contents(content: Column) -> Column:
    """Contents list before the first ``## `` after the title, unless one is there already."""
    after_title = F.position(F.lit("# "), content)  # 0-based place just behind the first '#'
    place = X.once(after_title, lambda a: F.struct(a.alias("a"), (F.position(F.lit("## "), content, a + 1) - 1).alias("at")))
    ready = content.contains("## Table of Contents") | content.contains("## Contents")

    def insert(x: Column) -> Column:
        at, found = x["place"]["at"], x["found"]
        inserted = F.concat(F.substr(content, F.lit(1), at), contents_list(found), F.substr(content, at + 1))
        return F.when(~ready & (F.size(found) > 0) & (at > x["place"]["a"]), inserted).otherwise(content)

    return X.once(F.struct(place.alias("place"), headings(content).alias("found")), insert)


def exercise_minutes(i: Column, n: Column) -> Column:
    """Estimated minutes of the ``i``-th (0-based) of ``n`` exercises."""
    return F.when(i == 0, 5).when(i == n - 1, 15).when(i > F.floor(n / 2), 12).otherwise(10)


def _exercise_headings(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(?m)^(## Exercise [0-9]+:)"), F.lit(1))


def exercises(docs: DataFrame) -> DataFrame:
    """(doc_id, content) to one row per exercise heading: number, total, minutes."""
    found = docs.select("doc_id", _exercise_headings(F.col("content")).alias("_h"))
    return found.select("doc_id", F.size("_h").cast("bigint").alias("n"), F.posexplode("_h").alias("i", "heading")).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("i"), "n", "heading",
        exercise_minutes(F.col("i"), F.col("n")).cast("bigint").alias("minutes"),
    )


def _insert_after_line(content: Column, mark: Column, note: Column) -> Column:
    """``note`` behind the line holding the first ``mark``; unchanged when the mark or its line end is missing."""
    end = X.once(F.position(mark, content), lambda at: F.when(at > 0, F.position(F.lit("\n"), content, at)))
    insert = lambda end: F.concat(F.substr(content, F.lit(1), end), note, F.substr(content, end + 1))
    return X.once(end, lambda end: F.when(end > 0, insert(end)).otherwise(content))


def annotate_exercises(content: Column) -> Column:
    def note(i: Column, n: Column) -> Column:
        return X.fill(
            F.lit(C.EXERCISE_NOTE), {"i": i + 1, "n": n, "minutes": exercise_minutes(i, n)}
        )

    def annotate(hs: Column) -> Column:
        marks = F.transform(hs, lambda h, i: F.struct(h.alias("h"), note(i, F.size(hs)).alias("note")))
        return F.aggregate(marks, content, lambda acc, m: _insert_after_line(acc, m["h"], m["note"]))

    return X.once(_exercise_headings(content), annotate)


def note_final_project(content: Column) -> Column:
    return F.when(
        content.rlike(r"(?m)^## Final Project"),
        _insert_after_line(content, F.lit("## Final Project"), F.lit(C.FINAL_PROJECT_NOTE)),
    ).otherwise(content)


def workshop(content: Column) -> Column:
    """All workshop steps in order. Each step's text is worked out once, however often the next one names it."""
    steps = [lambda c: X.strip_fences(c, ["markdown"]), insert_contents, annotate_exercises, note_final_project]
    for step in steps:
        content = X.once(content, step)
    return content


def fenced_blocks(docs: DataFrame) -> DataFrame:
    """One row per tagged code block."""
    p = F.lit(r"(?s)```(\w+)\n(.*?)```")
    c = F.col("content")
    zipped = F.arrays_zip(
        F.regexp_extract_all(c, p, F.lit(1)).alias("language"), F.regexp_extract_all(c, p, F.lit(2)).alias("code")
    )
    return docs.select("doc_id", F.posexplode(zipped).alias("pos", "b")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "b.language", "b.code",
        (F.col("b.language") == "mermaid").alias("is_mermaid"),
    )


# --- research --------------------------------------------------------------------------------------------------------


def research_complete(content: Column) -> Column:
    has = content.contains
    final = has("## Final Conclusion")
    section = (has("## Conclusion") | has("## Summary")) & ~X.contains_any(content, C.CONCLUSION_BLOCKERS)
    phrase = X.contains_any(content, C.CONCLUDING_PHRASES) | (has("Final") & has("Conclusion"))
    container = (
        has("Dockerfile") & (has("This Dockerfile") | has("The Dockerfile"))
        & ~has("Next Steps") & ~has("In the next iteration")
    )
    return final | section | phrase | container


def stage_type(content: Column, iteration: Column) -> Column:
    """plan / update / conclusion, or null when the text shows no stage."""
    update = F.concat(F.lit("## Research Update "), iteration.cast("string"))
    return (
        F.when((iteration == 1) & content.contains("## Research Plan"), "plan")
        .when(iteration.between(1, 4) & F.contains(content, update), "update")
        .when(content.contains("## Final Conclusion"), "conclusion")
    )


def stage_title(kind: Column, iteration: Column) -> Column:
    return (
        F.when(kind == "plan", "Research Plan")
        .when(kind == "update", F.concat(F.lit("Research Update "), iteration.cast("string")))
        .when(kind == "conclusion", "Final Conclusion")
    )


def stages(responses: DataFrame) -> DataFrame:
    """(conv_id, iteration, seq, content) to stage rows."""
    kind = stage_type(F.col("content"), F.col("iteration"))
    return (
        responses.withColumn("type", kind).where("type IS NOT NULL")
        .withColumn("title", stage_title(F.col("type"), F.col("iteration")))
    )


def upsert_stages(stage_rows: DataFrame) -> DataFrame:
    """Last content per (conversation, iteration, type); the place in the list is that of the first."""
    return stage_rows.groupBy("conv_id", "iteration", "type").agg(
        F.min("seq").alias("first_seq"),
        F.max_by("title", "seq").alias("title"),
        F.max_by("content", "seq").alias("content"),
    )


def stage_texts(runs: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """(keys, type, title, first_seq, block, content) from logged runs (keys with ``iteration``, from_seq, to_seq, text, type): the content of
    a stage is the answer's text up to the last run that shows it, as blocks (``whole_texts``)."""
    shown = runs.where("type IS NOT NULL").groupBy(*keys, "type").agg(F.min("to_seq").alias("first_seq"), F.max("to_seq").alias("_last"))
    shown = keep_small(shown)
    parts = runs.drop("type").join(shown, list(keys)).where("to_seq <= _last")
    texts = whole_texts(parts, [*keys, "type"], ["from_seq"], "text", out="content", **kw)
    title = stage_title(F.col("type"), F.col("iteration"))
    return texts.join(shown.drop("_last"), [*keys, "type"]).select(*keys, "type", title.alias("title"), "first_seq", "block", "content")


def force_conclusion(content: Column, iteration: Column) -> Column:
    forced = (iteration >= C.MAX_RESEARCH_ITERATIONS) & ~research_complete(content)
    return F.when(forced, F.concat(content, F.lit(C.FORCED_CONCLUSION))).otherwise(content)
