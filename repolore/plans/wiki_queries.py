"""Wiki plans, links, sections and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.operators import wiki
from repolore.operators.ordered import join_text
from repolore.plans.registry import query

_P, _S, _G = ("fx_wiki_pages",), ("fx_sections",), ("fx_wiki_pages", "fx_generated")


def xml_responses(t):
    """Model answers that carry each wiki's plan as XML: some fenced, with bare '&', broken inside, or cut off."""
    n, pos = F.col("n"), F.col("pos")

    def tag(name, c):
        return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))

    def tags(name, arr):
        return F.array_join(F.transform(arr, lambda x: tag(name, x)), "")

    w = t("fx_wikis")
    p = t("fx_wiki_pages").join(w, "wiki_id")
    no_id = (pos % 17 == 4) & (n % 6 != 1)
    page = F.concat(
        F.when(no_id, "<page>").otherwise(F.concat(F.lit('<page id="'), F.col("id"), F.lit('">'))),
        tag("title", F.concat("title", F.when(n % 5 == 0, " & more").otherwise(""))),
        F.lit("<description>about</description>"),
        F.when(pos % 7 == 3, "").when(pos % 7 == 5, "<importance>critical</importance>").otherwise(tag("importance", F.col("importance"))),
        tag("relevant_files", tags("file_path", F.col("file_paths"))), tag("related_pages", tags("related", F.col("related"))),
        F.lit("<parent_section>s1</parent_section></page  >"),
    )
    pages = join_text(p.select("wiki_id", "pos", page.alias("x")), ["wiki_id"], ["pos"], "x", out="pages").drop("n_chars", "error")
    section = F.concat(
        F.lit('<section id="'), F.col("section_id"), F.lit('">'), tag("title", F.col("title")),
        tag("pages", tags("page_ref", F.col("page_ids"))), tag("subsections", tags("section_ref", F.col("child_ids"))), F.lit("</section>"),
    )
    sections = join_text(t("fx_sections").select("wiki_id", "pos", section.alias("x")), ["wiki_id"], ["pos"], "x", out="sections").drop("n_chars", "error")
    body = F.concat(
        F.when(n % 4 == 0, "```xml\n").when(n % 3 == 0, "Here is the plan:\n").otherwise(""),
        F.lit("<wiki_structure>\n"), tag("title", F.concat(F.lit("Wiki "), F.col("wiki_id"))),
        tag("description", F.concat(F.lit("All"), F.when(n % 8 == 2, "\u0007").otherwise(""), F.when(n % 6 == 1, " a < b").otherwise(""),
                                    F.when(n % 5 == 0, " & co").otherwise(""))),
        tag("sections", F.col("sections")), tag("pages", F.col("pages")),
        F.when(n % 7 == 0, "").otherwise("</wiki_structure>"), F.when(n % 4 == 0, "\n```").otherwise(""),
    )
    return w.join(pages, "wiki_id").join(sections, "wiki_id").select("wiki_id", body.alias("response"))


@query("wik1_locate_xml", """SELECT wiki_id, n%7 <> 0 AS found, CASE WHEN n%7 = 0 THEN 'No valid XML found in response' END AS error
   FROM fx_wikis""", ("fx_wikis",))
def _(t):
    x = xml_responses(t).select("wiki_id", wiki.locate_xml(F.col("response")).alias("xml"))
    return x.select(
        "wiki_id", F.col("xml").isNotNull().alias("found"), F.when(F.col("xml").isNull(), "No valid XML found in response").alias("error")
    )


@query("wik2_repair_xml", """SELECT doc_id, concat(replace(text, '&', '&amp;'), ' a &amp; b &lt; &amp;copy; &quot;&amp;amp x>') AS xml FROM documents""")
def _(t):
    dirty = F.concat("text", F.lit(" a & b &lt; &copy; &quot;&amp x  >"))
    return t("documents").select("doc_id", wiki.repair_xml(dirty).alias("xml"))


_GOOD = "JOIN fx_wikis w ON w.wiki_id = p.wiki_id AND w.n%7 <> 0"
_PARSED_PAGES = f"""SELECT p.wiki_id, idx AS pos, CASE WHEN p.pos%17=4 AND n%6<>1 THEN concat('page-', idx+1) ELSE id END AS id,
   concat(title, CASE WHEN n%5=0 THEN ' & more' ELSE '' END) AS title,
   CASE p.pos%7 WHEN 3 THEN 'medium' WHEN 5 THEN 'low' ELSE importance END AS importance,
   array_to_string(file_paths, ',') AS files, array_to_string(related, ',') AS related
  FROM (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY pos) - 1 AS idx FROM fx_wiki_pages) p {_GOOD}"""


@query("wik3_parse_pages", _PARSED_PAGES, ("fx_wikis",))
def _(t):
    return wiki.page_rows(wiki.parse_xml(xml_responses(t))).select(
        "wiki_id", "pos", "id", "title", "importance", F.array_join("file_paths", ",").alias("files"),
        F.array_join("related", ",").alias("related"),
    )


@query("wik3_parse_sections", """SELECT p.wiki_id, p.pos - 1 AS pos, section_id, title, array_to_string(page_ids, ',') AS page_ids,
   array_to_string(child_ids, ',') AS child_ids FROM fx_sections p JOIN fx_wikis w ON w.wiki_id = p.wiki_id AND w.n%7 <> 0 AND w.n%6 <> 1""",
       ("fx_sections",))
def _(t):
    return wiki.section_rows(wiki.parse_xml(xml_responses(t))).select(
        "wiki_id", "pos", "section_id", "title", F.array_join("page_ids", ",").alias("page_ids"),
        F.array_join("child_ids", ",").alias("child_ids"),
    )


@query("wik4_pattern_parse", """SELECT wiki_id, CASE WHEN n%7 <> 0 THEN n%6 = 1 ELSE false END AS by_pattern,
   CASE WHEN n%7 <> 0 THEN concat('Wiki ', wiki_id) END AS title,
   CASE WHEN n%7 <> 0 THEN concat('All', CASE WHEN n%6=1 THEN ' a < b' ELSE '' END, CASE WHEN n%5=0 THEN ' & co' ELSE '' END) END AS description
   FROM fx_wikis""", ("fx_wikis",))
def _(t):
    return wiki.parse_xml(xml_responses(t)).select("wiki_id", "by_pattern", "title", "description")


_ROOTS = """roots AS (SELECT s.wiki_id, s.section_id, s.pos FROM fx_sections s WHERE NOT EXISTS (SELECT 1 FROM
   (SELECT wiki_id, unnest(child_ids) AS c FROM fx_sections) x WHERE x.wiki_id = s.wiki_id AND x.c = s.section_id))"""
_TREE = _ROOTS + """, edges AS (SELECT e.wiki_id, e.section_id AS parent, e.c FROM (SELECT wiki_id, section_id, unnest(child_ids) AS c
   FROM fx_sections) e JOIN fx_sections k ON k.wiki_id = e.wiki_id AND k.section_id = e.c),
 tree AS (SELECT wiki_id, section_id, 0::BIGINT AS depth, [section_id] AS path FROM roots UNION ALL
   SELECT t.wiki_id, e.c, t.depth+1, list_append(t.path, e.c) FROM tree t JOIN edges e ON e.wiki_id = t.wiki_id AND e.parent = t.section_id
   WHERE NOT list_contains(t.path, e.c))"""


@query("jn1_page_content", """SELECT p.wiki_id, p.id, coalesce(nullif(g.content, ''), 'Content not generated') AS content
   FROM fx_wiki_pages p LEFT JOIN fx_generated g ON g.wiki_id = p.wiki_id AND g.id = p.id""", _G)
def _(t):
    return wiki.with_content(t("fx_wiki_pages").drop("content"), t("fx_generated")).select("wiki_id", "id", "content")


@query("jn2_related_titles", """SELECT r.wiki_id, r.id, r.i - 1 AS rel_pos, r.related_id, p.title AS related_title
   FROM (SELECT wiki_id, id, i, related[i] AS related_id FROM fx_wiki_pages, unnest(range(1, 4)) u(i)) r
   JOIN fx_wiki_pages p ON p.wiki_id = r.wiki_id AND p.id = r.related_id""", _P)
def _(t):
    return wiki.related_titles(t("fx_wiki_pages"))


@query("jn3_section_pages", """SELECT r.wiki_id, r.section_id, r.i - 1 AS pos, r.id, p.title
   FROM (SELECT wiki_id, section_id, i, page_ids[i] AS id FROM fx_sections, unnest(range(1, 4)) u(i)) r
   JOIN fx_wiki_pages p ON p.wiki_id = r.wiki_id AND p.id = r.id""", _S)
def _(t):
    return wiki.section_pages(t("fx_sections"), t("fx_wiki_pages"))


@query("jn4_root_sections", "SELECT * FROM roots", _S, ctes=_ROOTS)
def _(t):
    return wiki.root_sections(t("fx_sections"))


_CAT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + f" THEN '{cid}'" for cid, _, words in C.CATEGORIES
) + " ELSE 'other' END"


@query("jn6_title_category", f"SELECT wiki_id, id, {_CAT} AS category FROM fx_wiki_pages", _P)
def _(t):
    return t("fx_wiki_pages").select("wiki_id", "id", wiki.title_category(F.col("title")).alias("category"))


@query("wik5_section_tree", "SELECT wiki_id, section_id, depth, array_to_string(path, '/') AS path FROM tree", _S, ctes=_TREE)
def _(t):
    s = t("fx_sections")
    return wiki.section_tree(s, wiki.root_sections(s)).withColumn("path", F.array_join("path", "/"))


_OUTLINE = _TREE + """, place AS (SELECT wiki_id, section_id, min(depth) AS d FROM tree GROUP BY ALL),
 links AS (SELECT e.wiki_id, e.section_id AS parent, s.pos AS ppos, e.i AS k, e.c FROM (SELECT wiki_id, section_id, generate_subscripts(child_ids, 1) - 1 AS i,
   unnest(child_ids) AS c FROM fx_sections) e JOIN fx_sections s ON s.wiki_id = e.wiki_id AND s.section_id = e.section_id
   JOIN fx_sections x ON x.wiki_id = e.wiki_id AND x.section_id = e.c),
 cand AS (SELECT l.*, row_number() OVER (PARTITION BY l.wiki_id, l.c ORDER BY p.d, ppos, k) = 1 AND q.d > 0 AS enters FROM links l
   JOIN place p ON p.wiki_id = l.wiki_id AND p.section_id = l.parent JOIN place q ON q.wiki_id = l.wiki_id AND q.section_id = l.c),
 outline AS (SELECT wiki_id, 'section' AS kind, section_id AS id, NULL::VARCHAR AS parent_id, 0::BIGINT AS depth, [1::BIGINT, pos::BIGINT] AS key FROM roots
  UNION ALL SELECT o.wiki_id, CASE WHEN c.enters THEN 'section' ELSE 'reference' END, c.c, c.parent, o.depth + 1, list_concat(o.key, [1::BIGINT, c.k::BIGINT])
   FROM outline o JOIN cand c ON o.kind = 'section' AND c.wiki_id = o.wiki_id AND c.parent = o.id),
 rows AS (SELECT * FROM outline UNION ALL SELECT o.wiki_id, 'page', r.p, o.id, o.depth + 1, list_concat(o.key, [0::BIGINT, r.i::BIGINT])
   FROM outline o JOIN (SELECT wiki_id, section_id, generate_subscripts(page_ids, 1) AS i, unnest(page_ids) AS p FROM fx_sections) r
   ON o.kind = 'section' AND r.wiki_id = o.wiki_id AND r.section_id = o.id JOIN (SELECT DISTINCT wiki_id, id FROM fx_wiki_pages) g ON g.wiki_id = r.wiki_id AND g.id = r.p)"""


@query("wik5_outline", """SELECT wiki_id, kind, id, parent_id, depth, row_number() OVER (PARTITION BY wiki_id ORDER BY key) - 1 AS entry,
   row_number() OVER (PARTITION BY wiki_id ORDER BY key) - 1 + (SELECT count(*) FROM rows x WHERE x.wiki_id = r.wiki_id AND len(x.key) > len(r.key)
    AND x.key[1:len(r.key)] = r.key) AS exit, NULL::VARCHAR AS error FROM rows r""", ("fx_sections", "fx_wiki_pages"), ctes=_OUTLINE)
def _(t):
    """Sections, references and pages in display order."""
    s = t("fx_sections")
    return wiki.section_outline(s, t("fx_wiki_pages"), wiki.root_sections(s))


@query("wik6_navigation", """SELECT wiki_id, 'section' AS kind, section_id AS item, depth FROM tree WHERE wiki_id IN (SELECT wiki_id FROM planned)
  UNION ALL SELECT wiki_id, 'page', id, 0 FROM fx_wiki_pages WHERE wiki_id NOT IN (SELECT wiki_id FROM planned)""", _S,
       ctes=_TREE + ", planned AS (SELECT w.wiki_id FROM fx_wikis w JOIN labels l ON l.doc_id = w.n WHERE l.quality = 1)")
def _(t):
    good = t("labels").where("quality = 1").select(F.col("doc_id").alias("n"))
    planned = t("fx_wikis").join(good, "n", "left_semi").select("wiki_id")
    s = t("fx_sections").join(planned, "wiki_id", "left_semi")
    return wiki.navigation(t("fx_wikis"), wiki.section_tree(s, wiki.root_sections(s)), t("fx_wiki_pages"))


_CAT_ROWS = [(c, x, i) for i, (c, x) in enumerate([(c, x) for c, x, _ in C.CATEGORIES] + [C.OTHER_CATEGORY])]
_CAT_VALUES = ", ".join(f"('{c}', '{x}', {i}::BIGINT)" for c, x, i in _CAT_ROWS)


@query("wik7_sections_by_title", f"""SELECT p.wiki_id, concat('section-', c.cid) AS section_id, c.label AS section_title, c.i AS section_pos,
   p.pos, p.id FROM (SELECT *, {_CAT} AS cat FROM fx_wiki_pages) p JOIN cats c ON c.cid = p.cat""", _P, ctes=f"cats(cid, label, i) AS (VALUES {_CAT_VALUES})")
def _(t):
    return wiki.sections_by_title(t("fx_wiki_pages"))


_IMP_VALUES = ", ".join(f"('{i}', '{s}', '{x}', {n}::BIGINT)" for n, (i, s, x) in enumerate(C.IMPORTANCE_SECTIONS))


@query("wik8_sections_by_importance", """SELECT p.wiki_id, c.sid AS section_id, c.label AS section_title, c.i AS section_pos, p.pos, p.id
   FROM fx_wiki_pages p JOIN cats c ON c.imp = p.importance""", _P, ctes=f"cats(imp, sid, label, i) AS (VALUES {_IMP_VALUES})")
def _(t):
    return wiki.sections_by_importance(t("fx_wiki_pages"))


_ALL3 = ("fx_wiki_pages", "fx_generated", "fx_in_flight")


@query("wik9_pending_pages", """SELECT wiki_id, pos, id FROM fx_wiki_pages p
   WHERE NOT EXISTS (SELECT 1 FROM fx_generated g WHERE g.wiki_id = p.wiki_id AND g.id = p.id AND g.content <> '')
     AND NOT EXISTS (SELECT 1 FROM fx_in_flight f WHERE f.wiki_id = p.wiki_id AND f.id = p.id)""", _ALL3)
def _(t):
    return wiki.pending_pages(t("fx_wiki_pages"), t("fx_generated"), t("fx_in_flight"))


@query("wik10_progress", """SELECT p.wiki_id, p.total, p.total - coalesce(b.n, 0) AS done, concat(coalesce(b.names, ''),
    CASE WHEN b.n > 3 THEN concat(' +', b.n - 3, ' more') ELSE '' END) AS in_progress
  FROM (SELECT wiki_id, count(*) AS total FROM fx_wiki_pages GROUP BY wiki_id) p LEFT JOIN
   (SELECT wiki_id, count(*) AS n, string_agg(title, ', ' ORDER BY seq) FILTER (rn <= 3) AS names FROM (SELECT f.*, p.title,
     row_number() OVER (PARTITION BY f.wiki_id ORDER BY seq) AS rn FROM fx_in_flight f JOIN fx_wiki_pages p ON p.wiki_id = f.wiki_id AND p.id = f.id)
    GROUP BY wiki_id) b ON b.wiki_id = p.wiki_id""", _ALL3)
def _(t):
    return wiki.progress(t("fx_wiki_pages"), t("fx_in_flight"))


@query("wik11_completion", """SELECT p.wiki_id, count(*) AS n_pages, count(g.id) AS n_generated,
   count(g.id) > 0 AND count(g.id) >= count(*) AND bool_and(coalesce(g.content <> '' AND g.content <> 'Loading...', false)) AS complete
  FROM fx_wiki_pages p LEFT JOIN fx_generated g ON g.wiki_id = p.wiki_id AND g.id = p.id GROUP BY p.wiki_id""", _ALL3)
def _(t):
    return wiki.completion(t("fx_wiki_pages"), t("fx_generated"))


@query("wik12_failure_content", """SELECT wiki_id, id, CASE WHEN importance = 'low' THEN 'Error generating content: timeout' ELSE content END AS content
   FROM fx_wiki_pages""", _P)
def _(t):
    error = F.when(F.col("importance") == "low", "timeout")
    return t("fx_wiki_pages").select("wiki_id", "id", wiki.content_or_failure(F.col("content"), error).alias("content"))
