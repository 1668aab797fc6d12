"""Packed context, slides, workshops and research stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.operators import derive
from repolore.plans.registry import query

_P = ("fx_wiki_pages",)
_LN = r"[^\n\r\x{2028}\x{2029}]"
_SUM_RE = rf"# {_LN}*?\n\n({_LN}*?)(\n\n|\z)"
_WS = r"^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+\z"
_SUMMARY = f"""CASE WHEN regexp_matches(content, '{_SUM_RE}') THEN regexp_replace(regexp_extract(content, '{_SUM_RE}', 1), '{_WS}', '', 'g')
   ELSE 'No summary available' END"""


@query("drv2_summary", f"SELECT wiki_id, id, {_SUMMARY} AS summary FROM fx_wiki_pages", _P)
def _(t):
    return t("fx_wiki_pages").select("wiki_id", "id", derive.summary(F.col("content")).alias("summary"))


_BUDGET = 12_000
_PACK_SQL = """SELECT * FROM p1 UNION ALL SELECT wiki_id, 2, pos, used, text FROM fold WHERE k > 0"""
_PACK = f"""ent AS (SELECT wiki_id, pos, importance = 'high' AS high, concat('## ', title, chr(10), content, chr(10), chr(10)) AS ftext,
   concat('## ', title, chr(10), {_SUMMARY}, chr(10), chr(10)) AS stext FROM fx_wiki_pages WHERE content <> ''),
 p1 AS (SELECT wiki_id, 1::BIGINT AS phase, pos, 'full' AS used, ftext AS text FROM (SELECT *, coalesce(sum(length(ftext)) OVER
   (PARTITION BY wiki_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ent WHERE high) WHERE b <= {_BUDGET}),
 oth AS (SELECT *, row_number() OVER (PARTITION BY wiki_id ORDER BY pos) AS k FROM ent WHERE NOT high),
 fold AS (SELECT w.wiki_id, 0::BIGINT AS k, coalesce(s.n, 0)::BIGINT AS total, NULL::BIGINT AS pos, NULL::VARCHAR AS used, NULL::VARCHAR AS text
   FROM (SELECT DISTINCT wiki_id FROM ent) w LEFT JOIN (SELECT wiki_id, sum(length(text)) AS n FROM p1 GROUP BY wiki_id) s ON s.wiki_id = w.wiki_id
   WHERE coalesce(s.n, 0) < {_BUDGET}
  UNION ALL SELECT f.wiki_id, o.k, (f.total + CASE WHEN f.total + length(o.ftext) <= {_BUDGET} THEN length(o.ftext) ELSE length(o.stext) END)::BIGINT,
   o.pos, CASE WHEN f.total + length(o.ftext) <= {_BUDGET} THEN 'full' ELSE 'summary' END,
   CASE WHEN f.total + length(o.ftext) <= {_BUDGET} THEN o.ftext ELSE o.stext END
   FROM fold f JOIN oth o ON o.wiki_id = f.wiki_id AND o.k = f.k + 1 WHERE f.total <= {_BUDGET})"""


@query("drv1_budget_pack", _PACK_SQL, _P, ctes=_PACK)
def _(t):
    return derive.pack(t("fx_wiki_pages"), _BUDGET)


@query("drv1_default_budget", _PACK_SQL, _P, ctes=_PACK.replace(str(_BUDGET), str(C.PACK_BUDGET)))
def _(t):
    return derive.pack(t("fx_wiki_pages"))


_DEFAULT = ", ".join("(" + f"{i}, '{s}')" for i, s in enumerate(C.DEFAULT_SLIDES))
_ITEMS = f"""items AS (SELECT doc_id, repo, i::BIGINT AS k0, item FROM (SELECT doc_id, repo, v.i, v.item FROM fx_plans, LATERAL (SELECT unnest(
   CASE doc_id%5 WHEN 0 THEN [concat('Intro: about ', repo), 'Design: parts: more', 'End'] WHEN 1 THEN [(SELECT concat('Intro: about ', lang)
     FROM documents d WHERE d.doc_id = fx_plans.doc_id), 'Design'] WHEN 2 THEN ['Intro', 'Design: x'] WHEN 3 THEN ['Big picture', 'Parts']
     ELSE list_transform({"[" + ", ".join("'" + s + "'" for s in C.DEFAULT_SLIDES) + "]"}, lambda s: replace(s, '{{repo}}', repo)) END) AS item,
   generate_subscripts(CASE doc_id%5 WHEN 0 THEN [1,1,1] WHEN 1 THEN [1,1] WHEN 2 THEN [1,1] WHEN 3 THEN [1,1] ELSE [1,1,1,1,1,1,1] END, 1) AS i) v))"""


@query("drv3_slide_plan", """SELECT doc_id AS deck_id, k0 AS k, count(*) OVER (PARTITION BY doc_id) AS n, item FROM items""", ("fx_plans",), ctes=_ITEMS)
def _(t):
    d = t("fx_plans").select(F.col("doc_id").alias("deck_id"), derive.slide_items(F.col("plan"), F.col("repo")).alias("i"))
    return d.select("deck_id", F.size("i").cast("bigint").alias("n"), F.posexplode("i").alias("k", "item")).withColumn(
        "k", (F.col("k") + 1).cast("bigint")
    )


@query("drv4_title_description", """SELECT doc_id, trim(string_split(item, ':')[1]) AS title, coalesce(trim(string_split(item, ':')[2]), '') AS description
   FROM (SELECT doc_id, concat(source, CASE WHEN doc_id%3>0 THEN concat(' : about ', lang) ELSE '' END, CASE WHEN doc_id%3>1 THEN ':x' ELSE '' END)
    AS item FROM documents)""")
def _(t):
    k = F.col("doc_id") % 3
    item = F.concat("source", F.when(k > 0, F.concat(F.lit(" : about "), "lang")).otherwise(""), F.when(k > 1, ":x").otherwise(""))
    return t("documents").select("doc_id", derive.title_of(item).alias("title"), derive.description_of(item).alias("description"))


@query("drv5_slide_numbers", """SELECT doc_id AS deck_id, k0 AS k, count(*) OVER (PARTITION BY doc_id) AS n, trim(string_split(item, ':')[1]) AS title,
   coalesce(trim(string_split(item, ':')[2]), '') AS description FROM items""", ("fx_plans",), ctes=_ITEMS)
def _(t):
    return derive.slide_plan(t("fx_plans").select(F.col("doc_id").alias("deck_id"), "repo", "plan"))


def slide_responses(t):
    """Slide answers of every kind around each document's text."""
    k = F.col("doc_id") % 5
    body = F.regexp_replace("text", r"[<>`]", "")
    r = (
        F.when(k == 0, F.concat(F.lit("Sure:\n```html\n<p>"), body, F.lit("</p>\n```\nDone")))
        .when(k == 1, F.concat(F.lit('x <div class="slide"><div>'), body, F.lit("</div> </div> tail")))
        .when(k == 2, F.concat(F.lit("pre <Section a='1'>"), body, F.lit("</section> post")))
        .when(k == 3, F.concat(F.lit("<style>b{}</style>"), body))
        .otherwise(body)
    )
    return t("documents").select("doc_id", "source", r.alias("response"))


@query("drv6_slide_html", """SELECT doc_id, CASE WHEN doc_id%5 = 3 THEN html ELSE concat('<div class="slide"><div class="slide-header">', source,
   '</div><div class="content">', html, '</div></div>') END AS html FROM (SELECT doc_id, source, CASE doc_id%5 WHEN 0 THEN concat('<p>', b, '</p>')
   WHEN 1 THEN concat('<div class="slide"><div>', b, '</div> </div>') WHEN 2 THEN concat('<Section a=''1''>', b, '</section>')
   WHEN 3 THEN '<style>b{}</style>' ELSE b END AS html FROM (SELECT *, regexp_replace(text, '[<>`]', '', 'g') AS b FROM documents))""")
def _(t):
    return slide_responses(t).select("doc_id", derive.slide_html(F.col("response"), F.col("source")).alias("html"))


_W = ("fx_workshops",)
_SLUG = r"regexp_replace(regexp_replace(lower(h), '[^0-9A-Za-z_\t-\r\x1c-\x20\x{85}\p{Z}-]', '', 'g'), '[\t-\r\x1c-\x20\x{85}\p{Z}]+', '-', 'g')"
_TOC = rf"""toc AS (SELECT doc_id, content, concat('## Table of Contents', chr(10), chr(10), array_to_string(list_transform(
   regexp_extract_all(content, '(?m)^## (.*)$', 1), lambda h: concat('- [', h, '](#', {_SLUG}, ')', chr(10))), ''), chr(10)) AS toc,
   strpos(content, '# ') AS a FROM fx_workshops),
 placed AS (SELECT *, strpos(substr(content, a+1), '## ') + a - 1 AS cut FROM toc)"""


@query("drv7_contents", """SELECT doc_id, concat(substr(content, 1, cut), toc, substr(content, cut+1)) AS content FROM placed""", _W, ctes=_TOC)
def _(t):
    return t("fx_workshops").select("doc_id", derive.insert_contents(F.col("content")).alias("content"))


@query("drv8_exercises", """SELECT doc_id, i, n, concat('## Exercise ', x, ':') AS heading, CASE WHEN i = 1 THEN 5::BIGINT WHEN i = n THEN 15::BIGINT
   WHEN i - 1 > n//2 THEN 12::BIGINT ELSE 10::BIGINT END AS minutes
  FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY x) AS i, count(*) OVER (PARTITION BY doc_id) AS n
   FROM fx_workshops, unnest([1, 2, 3, 4]) u(x) WHERE x = 1 OR (x = 2 AND doc_id%2=0) OR (x > 2 AND doc_id%3=0))""", _W)
def _(t):
    return derive.exercises(t("fx_workshops"))


def _noted(content: str) -> str:
    """SQL: ``content`` with the note behind each exercise heading; the workshop has ``n`` of them."""
    for heading, i, minutes in (("1: Start, now!", "1", "5"), ("2: More_x", "2", "CASE WHEN n = 2 THEN 15 ELSE 10 END"), ("3: Deep", "n - 1", "10"), ("4: Last", "n", "15")):
        mark = f"'## Exercise {heading}' || chr(10)"
        content = f"""replace({content}, {mark}, concat({mark}, '<div style="text-align: right; font-size: 0.85em; color: #666;">', chr(10),
   'Exercise ', {i}, ' of ', n, ' | Estimated time: ', {minutes}, ' minutes', chr(10), '</div>', chr(10), chr(10)))"""
    return content


_N_EXERCISES = "1 + CASE WHEN doc_id%2=0 THEN 1 ELSE 0 END + CASE WHEN doc_id%3=0 THEN 2 ELSE 0 END"


@query("drv8_annotated", f"SELECT doc_id, {_noted('content')} AS content FROM (SELECT *, {_N_EXERCISES} AS n FROM fx_workshops)", _W)
def _(t):
    return t("fx_workshops").select("doc_id", derive.annotate_exercises(F.col("content")).alias("content"))


@query("drv9_final_project", """SELECT doc_id, replace(content, concat('## Final Project', chr(10), 'Build.'), concat('## Final Project', chr(10),
   '<div style="text-align: right; font-size: 0.85em; color: #666;">', chr(10), 'Estimated time: 20-30 minutes | Combines concepts from all exercises',
   chr(10), '</div>', chr(10), chr(10), 'Build.')) AS content FROM fx_workshops""", _W)
def _(t):
    return t("fx_workshops").select("doc_id", derive.note_final_project(F.col("content")).alias("content"))


@query("job_workshop", f"""SELECT doc_id, replace(noted, concat('## Final Project', chr(10), 'Build.'), concat('## Final Project', chr(10),
   '<div style="text-align: right; font-size: 0.85em; color: #666;">', chr(10), 'Estimated time: 20-30 minutes | Combines concepts from all exercises',
   chr(10), '</div>', chr(10), chr(10), 'Build.')) AS content
  FROM (SELECT doc_id, {_noted("concat(substr(content, 1, cut), toc, substr(content, cut+1))")} AS noted FROM (SELECT *, {_N_EXERCISES} AS n FROM placed))""", _W, ctes=_TOC)
def _(t):
    """All steps on answers that come inside a code fence."""
    fenced = F.concat(F.lit("```markdown"), F.col("content"), F.lit("```"))
    return t("fx_workshops").select("doc_id", derive.workshop(fenced).alias("content"))


@query("drv10_fenced_blocks", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY x) - 1 AS pos, CASE x WHEN 1 THEN 'python' ELSE 'mermaid' END
   AS language, CASE x WHEN 1 THEN concat('x = 1', chr(10)) ELSE concat('a-->b', chr(10)) END AS code, x = 2 AS is_mermaid
  FROM fx_workshops, unnest([1, 2]) u(x) WHERE (x = 1 AND doc_id%2=0) OR (x = 2 AND doc_id%3=0)""", _W)
def _(t):
    return derive.fenced_blocks(t("fx_workshops"))


_R = ("fx_responses",)
_COMPLETE = """(contains(content, '## Final Conclusion') OR ((contains(content, '## Conclusion') OR contains(content, '## Summary'))
   AND NOT contains(content, 'I will now proceed to') AND NOT contains(content, 'Next Steps') AND NOT contains(content, 'next iteration'))
  OR contains(content, 'This concludes our research') OR contains(content, 'This completes our investigation')
  OR contains(content, 'This concludes the deep research process') OR contains(content, 'Key Findings and Implementation Details')
  OR contains(content, 'In conclusion,') OR (contains(content, 'Final') AND contains(content, 'Conclusion'))
  OR (contains(content, 'Dockerfile') AND (contains(content, 'This Dockerfile') OR contains(content, 'The Dockerfile'))
   AND NOT contains(content, 'Next Steps') AND NOT contains(content, 'In the next iteration')))"""
_TYPE = """CASE WHEN iteration = 1 AND contains(content, '## Research Plan') THEN 'plan'
   WHEN iteration BETWEEN 1 AND 4 AND contains(content, concat('## Research Update ', iteration)) THEN 'update'
   WHEN contains(content, '## Final Conclusion') THEN 'conclusion' END"""


@query("drv11_research_complete", f"SELECT conv_id, seq, {_COMPLETE} AS complete FROM fx_responses", _R)
def _(t):
    return t("fx_responses").select("conv_id", "seq", derive.research_complete(F.col("content")).alias("complete"))


@query("drv12_stages", f"""SELECT conv_id, iteration, seq, type, CASE type WHEN 'plan' THEN 'Research Plan' WHEN 'update' THEN
   concat('Research Update ', iteration) ELSE 'Final Conclusion' END AS title FROM (SELECT *, {_TYPE} AS type FROM fx_responses) WHERE type IS NOT NULL""", _R)
def _(t):
    return derive.stages(t("fx_responses")).select("conv_id", "iteration", "seq", "type", "title")


def _drafts(t):
    """Stages seen twice: a first draft and the later full text."""
    s = derive.stages(t("fx_responses"))
    draft = s.withColumn("content", F.substring("content", 1, 20)).withColumn("seq", F.col("seq") - 1)
    return s.unionByName(draft)


@query("drv13_stage_upsert", f"""SELECT conv_id, iteration, type, min(seq) - 1 AS first_seq, arg_max(content, seq) AS content,
   CASE type WHEN 'plan' THEN 'Research Plan' WHEN 'update' THEN concat('Research Update ', iteration) ELSE 'Final Conclusion' END AS title
   FROM (SELECT *, {_TYPE} AS type FROM fx_responses) WHERE type IS NOT NULL GROUP BY conv_id, iteration, type""", _R)
def _(t):
    return derive.upsert_stages(_drafts(t))


@query("drv14_forced_conclusion", f"""SELECT conv_id, seq, CASE WHEN seq%2 = 1 AND NOT {_COMPLETE} THEN concat(content, '{C.FORCED_CONCLUSION.replace("'", "''")}')
   ELSE content END AS content FROM fx_responses""", _R)
def _(t):
    turn = F.when(F.col("seq") % 2 == 1, 5).otherwise(4)
    return t("fx_responses").select("conv_id", "seq", derive.force_conclusion(F.col("content"), turn).alias("content"))
