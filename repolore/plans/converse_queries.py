"""Request intake, conversation state and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import urls
from repolore.operators import converse, corpus, generate, retrieve
from repolore.operators.ordered import join_text
from repolore.plans import vector_queries as V
from repolore.plans.corpus_queries import _LISTED, _NAME
from repolore.plans.identity_queries import _LANG_VALUES
from repolore.plans.registry import query

_TAG = C.RESEARCH_TAG
_WS = "chr(32)||chr(9)||chr(10)||chr(13)"
_PAIRS = """pairs AS (SELECT a.conv_id, a.turn//2 AS pair_no, a.content AS user_text, b.content AS assistant_text
   FROM fx_messages a JOIN fx_messages b ON b.conv_id = a.conv_id AND b.turn = a.turn+1
   WHERE a.turn%2 = 0 AND a.role = 'user' AND b.role = 'assistant')"""
_STATE = f"""agg AS (SELECT conv_id, count(*) AS n_messages, arg_max(role, turn) AS last_role, arg_max(content, turn) AS last_content,
   bool_or(contains(content, '{_TAG}')) AS is_research, count(*) FILTER (role = 'assistant') AS n_replies,
   arg_min(content, turn) FILTER (role = 'user' AND NOT contains(lower(content), 'continue')) AS topic
   FROM fx_messages GROUP BY conv_id),
 last AS (SELECT *, CASE WHEN contains(last_content, '{_TAG}') THEN trim(replace(last_content, '{_TAG}', ''), {_WS}) ELSE last_content END
   AS cleaned, trim(replace(topic, '{_TAG}', ''), {_WS}) AS clean_topic FROM agg),
 state AS (SELECT *, CASE WHEN is_research THEN n_replies+1 ELSE 1 END AS iteration,
   CASE WHEN is_research AND contains(lower(cleaned), 'continue') AND contains(lower(cleaned), 'research')
     AND coalesce(clean_topic, '') <> '' THEN clean_topic ELSE cleaned END AS query FROM last),
 phased AS (SELECT *, CASE WHEN NOT is_research THEN 'simple' WHEN iteration = 1 THEN 'first' WHEN iteration >= 5 THEN 'final'
   ELSE 'intermediate' END AS phase FROM state)"""


def _state(t):
    return converse.request_state(t("fx_messages"))


def _bodies(t):
    """Request JSON as a client sends it; absent fields are left out."""
    message = F.to_json(F.struct("role", "content"))
    msgs = join_text(t("fx_messages").select("conv_id", "turn", message.alias("m")), ["conv_id"], ["turn"], "m", ",", "ms")
    even = F.col("conv_id") % 2 == 0
    rest = F.to_json(
        F.struct(
            "repo_url", F.col("file_path").alias("filePath"), F.when(even, F.col("type")).alias("type"),
            F.when(~even, F.col("provider")).alias("provider"), "model", "language", "excluded_dirs",
        )
    )
    body = F.concat(F.lit('{"messages":['), F.col("ms"), F.lit("],"), F.substr(rest, F.lit(2)))
    return t("fx_requests").join(msgs, "conv_id").select("conv_id", body.alias("body"))


@query("src8_request_intake", """SELECT r.conv_id, r.repo_url, CASE WHEN r.conv_id%2=0 THEN r.type ELSE 'github' END AS type,
   CASE WHEN r.conv_id%2=1 THEN r.provider ELSE 'google' END AS provider, r.model, coalesce(r.language, 'en') AS language, r.file_path,
   r.excluded_dirs, a.n_messages::INTEGER AS n_messages, a.last_content FROM fx_requests r JOIN phased a USING (conv_id)""",
       ("fx_requests", "fx_messages"), ctes=_STATE)
def _(t):
    r = converse.parse_requests(_bodies(t))
    return r.select(
        "conv_id", "repo_url", "type", "provider", "model", "language", "file_path", "excluded_dirs",
        F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last_content"),
    )


@query("cnv1_pair_turns", "SELECT * FROM pairs", ("fx_messages",), ctes=_PAIRS)
def _(t):
    return converse.pair_turns(t("fx_messages"))


_TURN = """concat('<turn>', chr(10), '<user>', user_text, '</user>', chr(10), '<assistant>', assistant_text, '</assistant>', chr(10),
   '</turn>', chr(10))"""


@query("cnv2_history", f"""SELECT conv_id, 0::BIGINT AS block, string_agg({_TURN}, '' ORDER BY pair_no) AS history,
   sum(length({_TURN}))::BIGINT AS n_chars FROM pairs GROUP BY conv_id""", ("fx_messages",), ctes=_PAIRS)
def _(t):
    return converse.history_blocks(converse.pair_turns(t("fx_messages"))).withColumn("n_chars", F.length("history").cast("bigint"))


@query("cnv2_numbered_history", """SELECT conv_id, 0::BIGINT AS block, string_agg(concat(pair_no, '.', chr(10), 'User: ', user_text, chr(10), 'You: ',
   assistant_text, chr(10)), '' ORDER BY pair_no) AS history FROM pairs GROUP BY conv_id""", ("fx_messages",), ctes=_PAIRS)
def _(t):
    return converse.numbered_history(converse.pair_turns(t("fx_messages")))


@query("cnv3_validation", """SELECT d.doc_id AS conv_id, CASE WHEN a.n_messages IS NULL OR a.last_role <> 'user' THEN 400::BIGINT END AS error_code,
   CASE WHEN a.n_messages IS NULL THEN 'No messages provided' WHEN a.last_role <> 'user' THEN 'Last message must be from the user' END
   AS error FROM documents d LEFT JOIN agg a ON a.conv_id = d.doc_id""", ("fx_messages",), ctes=_STATE)
def _(t):
    requests = t("documents").select(F.col("doc_id").alias("conv_id"))
    return converse.validate(requests, _state(t))


@query("cnv4_research_tag", f"""SELECT m.conv_id, m.turn, m.role, CASE WHEN m.role = a.last_role AND m.content = a.last_content
   AND contains(m.content, '{_TAG}') THEN trim(replace(m.content, '{_TAG}', ''), {_WS}) ELSE m.content END AS content, a.is_research
   FROM fx_messages m JOIN agg a USING (conv_id)""", ("fx_messages",), ctes=_STATE)
def _(t):
    return converse.strip_tags(t("fx_messages"), _state(t))


@query("cnv5_iteration", "SELECT conv_id, is_research, iteration FROM state", ("fx_messages",), ctes=_STATE)
def _(t):
    return _state(t).select("conv_id", "is_research", "iteration")


@query("cnv6_topic", "SELECT conv_id, query FROM state", ("fx_messages",), ctes=_STATE)
def _(t):
    return _state(t).select("conv_id", "query")


@query("cnv7_phase", "SELECT conv_id, phase FROM phased", ("fx_messages",), ctes=_STATE)
def _(t):
    return _state(t).select("conv_id", "phase")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CASES = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in converse.PHASE_TEMPLATES.items())
_SYSTEM = f"""langs(code, name) AS (VALUES {_LANG_VALUES}), sys AS (SELECT r.conv_id, r.repo, r.file_path, r.provider, p.query,
   replace(replace(replace(replace(replace(replace(replace(CASE p.phase {_CASES} END, '{{{{', chr(1)), '}}}}', chr(2)),
    '{{repo_type}}', r.type), '{{repo_url}}', r.repo_url), '{{repo_name}}', string_split(r.repo_url, '/')[-1]),
    '{{language_name}}', coalesce(l.name, 'English')), '{{research_iteration}}', p.iteration::VARCHAR) AS filled
   FROM fx_requests r JOIN phased p USING (conv_id) LEFT JOIN langs l ON l.code = coalesce(r.language, 'en')),
 system AS (SELECT *, replace(replace(filled, chr(1), '{{'), chr(2), '}}') AS system_prompt FROM sys)"""


def _requests(t):
    """Requests with state and system prompt."""
    r = t("fx_requests").join(_state(t).select("conv_id", "query", "phase", "iteration"), "conv_id")
    prompt = converse.system_prompt(
        F.col("phase"), F.col("type"), F.col("repo_url"), urls.language_name(F.col("language")), F.col("iteration")
    )
    return r.withColumn("system_prompt", prompt)


@query("cnv8_system_prompt", "SELECT conv_id, system_prompt FROM system", ("fx_requests", "fx_messages"), ctes=_STATE + ", " + _SYSTEM)
def _(t):
    return _requests(t).select("conv_id", "system_prompt")


def _prompt_sql(middle: str) -> str:
    return f"""SELECT s.conv_id, 0::BIGINT AS block, concat('/no_think ', s.system_prompt, chr(10), chr(10),
  CASE WHEN h.history IS NOT NULL THEN concat('<conversation_history>', chr(10), h.history, '</conversation_history>', chr(10), chr(10)) ELSE '' END,
  CASE WHEN f.text <> '' THEN concat('<currentFileContent path="', s.file_path, '">', chr(10), f.text, chr(10), '</currentFileContent>',
    chr(10), chr(10)) ELSE '' END, {middle}, '<query>', chr(10), s.query, chr(10), '</query>', chr(10), chr(10), 'Assistant: ',
  CASE WHEN s.provider = 'ollama' THEN ' /no_think' ELSE '' END) AS prompt
 FROM system s LEFT JOIN (SELECT conv_id, string_agg({_TURN}, '' ORDER BY pair_no) AS history FROM pairs GROUP BY conv_id) h
   ON h.conv_id = s.conv_id LEFT JOIN fx_files f ON f.repo = s.repo AND f.file_path = s.file_path"""


_CTX_JOIN = """ LEFT JOIN (SELECT query_id, concat(chr(10), chr(10), '----------', string_agg(part, chr(10)||chr(10) ORDER BY first_rank))
   AS context FROM parts GROUP BY query_id) c ON c.query_id = s.conv_id"""
_ALL_FX = ("fx_requests", "fx_messages", "fx_queries", "fx_chunk_vectors")


def _with_files(t):
    """Requests with the file that they name."""
    return corpus.file_for_requests(_requests(t), t("fx_files"))


@query("cnv9_full_prompt", _prompt_sql("""CASE WHEN c.context IS NULL THEN concat('<note>Answering without retrieval augmentation.</note>',
   chr(10), chr(10)) ELSE concat('<START_OF_CONTEXT>', chr(10), c.context, chr(10), '<END_OF_CONTEXT>', chr(10), chr(10)) END""") + _CTX_JOIN,
       _ALL_FX, ctes=", ".join([_STATE, _SYSTEM, _PAIRS, V._HITS, V._CONTEXT]))
def _(t):
    context = retrieve.context_text(V.hits(t)).withColumnRenamed("query_id", "conv_id")
    asked = _with_files(t).join(context, "conv_id", "left")
    return converse.prompt_blocks(asked, converse.pair_turns(t("fx_messages")), converse.context_block(F.col("context")))


_SHORT_PROMPT = _prompt_sql("""'<note>Answering without retrieval augmentation due to input size constraints.</note>',
   chr(10), chr(10)""")


@query("cnv10_simplified_prompt", _SHORT_PROMPT, _ALL_FX[:2], ctes=", ".join([_STATE, _SYSTEM, _PAIRS]))
def _(t):
    return converse.prompt_blocks(_with_files(t), converse.pair_turns(t("fx_messages")), F.lit(converse.SIMPLIFIED))


@query("cnv12_structure_prompt", f"""SELECT r.repo, 0::BIGINT AS block, concat('Plan a wiki for repository ', r.repo, '.', chr(10), chr(10), '<file_tree>', chr(10),
   r.file_tree, chr(10), '</file_tree>', chr(10), chr(10), '<readme>', chr(10), coalesce(m.readme, ''), chr(10), '</readme>', chr(10), chr(10),
   'Reply with one <wiki_structure> XML document.') AS prompt
  FROM (SELECT repo, string_agg(file_path, chr(10) ORDER BY file_path) FILTER ({_LISTED}) AS file_tree FROM fx_files GROUP BY repo) r
  LEFT JOIN (SELECT repo, text AS readme FROM (SELECT *, row_number() OVER (PARTITION BY repo
   ORDER BY len(string_split(file_path, '/')), file_path, text) AS rn FROM fx_files
   WHERE lower({_NAME}) = 'readme.md' AND text <> '' AND {_LISTED}) WHERE rn = 1) m USING (repo)""", ("fx_files",))
def _(t):
    f = t("fx_files")
    return converse.structure_prompt_blocks(f.select("repo").distinct(), corpus.list_tree(f), corpus.pick_readme(f))


@query("cnv13_page_prompt", """SELECT wiki_id, id, concat('Write the wiki page ''', title, ''' in Markdown.', chr(10), chr(10), '<details>', chr(10),
   '<summary>Relevant source files</summary>', chr(10), chr(10), array_to_string(list_transform(file_paths, lambda p:
    concat('- [', p, '](https://github.com/o/', wiki_id, '/blob/main/', p, ')')), chr(10)), chr(10), '</details>', chr(10), chr(10), '# ', title)
   AS prompt FROM fx_wiki_pages""", ("fx_wiki_pages",))
def _(t):
    url = F.concat(F.lit("https://github.com/o/"), F.col("wiki_id"))

    def link(p):
        return urls.file_link(F.lit("github"), url, F.lit("main"), p)

    return t("fx_wiki_pages").select(
        "wiki_id", "id",
        converse.page_prompt(F.col("title"), converse.file_list_markup(F.col("file_paths"), link)).alias("prompt"),
    )


@query("jn5_model_parameters", """SELECT r.conv_id, r.provider, coalesce(r.model, d.model) AS model, coalesce(m.params, d.params) AS params,
   CASE WHEN d.model IS NULL THEN 'unknown provider' END AS error FROM fx_requests r
  LEFT JOIN fx_models d ON d.provider = r.provider AND d.is_default
  LEFT JOIN fx_models m ON m.provider = r.provider AND m.model = coalesce(r.model, d.model)""", ("fx_requests", "fx_models"))
def _(t):
    return converse.model_parameters(t("fx_requests").select("conv_id", "provider", "model"), t("fx_models"))


@query("prj14_split_prompt", """SELECT conv_id, pair_no, CASE WHEN pair_no%2=0 THEN 2 ELSE 1 END AS n_messages,
   CASE WHEN pair_no%2=0 THEN 'system' ELSE 'user' END AS first_role,
   CASE WHEN pair_no%2=0 THEN trim(user_text, chr(32)||chr(9)||chr(10)||chr(13)) ELSE user_text END AS first_content,
   CASE WHEN pair_no%2=0 THEN trim(assistant_text, chr(32)||chr(9)||chr(10)||chr(13)) ELSE user_text END AS last_content FROM pairs""",
       ("fx_messages",), ctes=_PAIRS)
def _(t):
    tagged = F.concat(
        F.lit("<START_OF_SYSTEM_PROMPT>\n"), F.col("user_text"), F.lit("\n<END_OF_SYSTEM_PROMPT>\n<START_OF_USER_PROMPT> "),
        F.col("assistant_text"), F.lit("\n<END_OF_USER_PROMPT>"),
    )
    p = F.when(F.col("pair_no") % 2 == 0, tagged).otherwise(F.col("user_text"))
    m = converse.pair_turns(t("fx_messages")).select("conv_id", "pair_no", generate.split_tagged_prompt(p).alias("m"))
    return m.select(
        "conv_id", "pair_no", F.size("m").alias("n_messages"), F.get("m", F.lit(0))["role"].alias("first_role"),
        F.get("m", F.lit(0))["content"].alias("first_content"), F.element_at("m", -1)["content"].alias("last_content"),
    )


@query("prj15_image_part", """SELECT page_id, 'image_url' AS type, CASE WHEN page_id%2=0 THEN url
   ELSE concat('data:image/jpeg;base64,', base64(encode(html))) END AS url, 'auto' AS detail FROM pages""")
def _(t):
    src = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/img/"), F.col("page_id")))
    part = generate.image_part(src, F.encode("html", "UTF-8"))
    p = t("pages").select("page_id", part.alias("p"))
    return p.select("page_id", "p.type", "p.image_url.url", "p.image_url.detail")
