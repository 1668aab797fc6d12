"""Model calls, payloads, responses, usage and streamed deltas."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from repolore.functions import text as X
from repolore.operators import generate
from repolore.plans.converse_queries import _STATE, _state
from repolore.plans.registry import query
from repolore.session import cut_lineage

_WORDS = r"len(list_filter(regexp_split_to_array({}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+'), lambda x: x <> ''))"
_FIRST = "string_split(text, chr(10))[1]"


@query("gen1_generate", f"""SELECT doc_id, CASE WHEN NOT contains(text, 'the ') THEN concat('echo: ', {_FIRST}) END AS response,
   CASE WHEN contains(text, 'the ') THEN 'model unavailable' END AS error,
   CASE WHEN NOT contains(text, 'the ') THEN {_WORDS.format('text')} END AS prompt_tokens,
   CASE WHEN NOT contains(text, 'the ') THEN {_WORDS.format(_FIRST)} + 1 END AS completion_tokens FROM documents""")
def _(t):
    make = partial(generate.EchoGenerator, None, "the ")
    out = generate.generate(t("documents").select("doc_id", F.col("text").alias("prompt")), make)
    return out.select("doc_id", "response", "error", "prompt_tokens", "completion_tokens")


_FAMILIES = ["anthropic.model-x", "amazon.model-t", "cohere.model-c", "ai21.model-j", "meta.model-l"]


@query("gen2_payload", """SELECT conv_id, family, CASE family
   WHEN 'anthropic' THEN concat('{"anthropic_version":"bedrock-2023-05-31","messages":[{"role":"user","content":[{"type":"text","text":', q,
     '}]}],"max_tokens":4096}')
   WHEN 'amazon' THEN concat('{"inputText":', q, ',"textGenerationConfig":{"maxTokenCount":4096,"stopSequences":[],"temperature":0.7,"topP":0.8}}')
   WHEN 'cohere' THEN concat('{"prompt":', q, ',"max_tokens":4096,"temperature":0.7,"p":0.8}')
   WHEN 'ai21' THEN concat('{"prompt":', q, ',"maxTokens":4096,"temperature":0.7,"topP":0.8}')
   ELSE concat('{"prompt":', q, '}') END AS payload
  FROM (SELECT conv_id, to_json(query)::VARCHAR AS q, CASE conv_id%5 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'amazon' WHEN 2 THEN 'cohere'
    WHEN 3 THEN 'ai21' ELSE 'meta' END AS family FROM phased)""", ("fx_messages",), ctes=_STATE)
def _(t):
    model = F.element_at(F.array(*[F.lit(f) for f in _FAMILIES]), (F.col("conv_id") % 5 + 1).cast("int"))
    s = _state(t).select("conv_id", "query", generate.vendor_family(model).alias("family"))
    return s.select("conv_id", "family", generate.payload(F.col("family"), F.col("query")).alias("payload"))


@query("gen3_response_text", "SELECT id, want AS text FROM fx_completions", ("fx_completions",))
def _(t):
    return t("fx_completions").select("id", generate.response_text(F.col("provider"), F.col("raw")).alias("text"))


@query("gen4_usage", """SELECT provider, model, count(*) AS calls, count(*) FILTER (ptok IS NULL) AS without_usage,
   sum(CASE WHEN ptok IS NOT NULL THEN id%10 END)::BIGINT AS completion_tokens, sum(ptok)::BIGINT AS prompt_tokens,
   sum(ptok + id%10)::BIGINT AS total_tokens FROM fx_completions GROUP BY provider, model""", ("fx_completions",))
def _(t):
    return generate.usage_totals(t("fx_completions"))


@query("gen5_choices", """SELECT id, i AS choice, CASE i WHEN 0 THEN want WHEN 1 THEN 'second' ELSE 'third' END AS content
   FROM fx_completions, unnest(range(0, n_choices)) u(i) WHERE provider = 'openai'""", ("fx_completions",))
def _(t):
    return generate.choices(t("fx_completions"))


@query("gen6_logprobs", """SELECT id, 0::BIGINT AS choice, i AS pos, CASE i WHEN 0 THEN 'a' ELSE want END AS token,
   CASE i WHEN 0 THEN -0.5 ELSE -1.25 END::DOUBLE AS logprob FROM fx_completions, unnest(range(0, 2)) u(i) WHERE provider = 'openai'""",
       ("fx_completions",))
def _(t):
    return generate.token_logprobs(t("fx_completions"))


@query("gen7_redrive", f"""SELECT doc_id, CASE WHEN {_WORDS.format('text')} > 400 THEN 2::BIGINT ELSE 1::BIGINT END AS attempt,
   CASE WHEN {_WORDS.format('text')} > 400 THEN concat('echo: short form of ', doc_id) ELSE concat('echo: ', {_FIRST}) END AS response,
   NULL::VARCHAR AS error FROM documents""")
def _(t):
    make = partial(generate.EchoGenerator, 400)
    first = cut_lineage(generate.generate(t("documents").select("doc_id", F.col("text").alias("prompt")), make))
    short = F.concat(F.lit("short form of "), F.col("doc_id").cast("string"))
    return generate.redrive(first, short, make).select("doc_id", "attempt", "response", "error")


@query("gen8_strip_fences", """SELECT doc_id, text FROM (SELECT doc_id, text FROM documents)""")
def _(t):
    tag = F.when(F.col("doc_id") % 3 == 0, "```markdown\n").when(F.col("doc_id") % 3 == 1, "```Markdown \n").otherwise("")
    wrapped = F.concat(tag, F.col("text"), F.when(F.col("doc_id") % 2 == 0, "```\n").otherwise(""))
    return t("documents").select("doc_id", X.strip_fences(wrapped, ["markdown"]).alias("text"))


_KEEP = "coalesce(delta, '') <> '' AND NOT starts_with(delta, 'model=') AND NOT starts_with(delta, 'created_at=')"


@query("gen9_delta_noise", f"""SELECT response_id, seq, replace(replace(delta, '<think>', ''), '</think>', '') AS delta FROM fx_deltas
   WHERE {_KEEP}""", ("fx_deltas",))
def _(t):
    d = F.col("delta")
    return t("fx_deltas").where(generate.keep_delta(d)).select("response_id", "seq", generate.drop_think_tags(d).alias("delta"))


@query("gen10_fold_deltas", """SELECT response_id, 0::BIGINT AS block, string_agg(coalesce(delta, ''), '' ORDER BY seq) AS content,
   sum(length(coalesce(delta, '')))::BIGINT AS n_chars,
   arg_max(id, seq) FILTER (id <> '') AS id, arg_max(model, seq) FILTER (model IS NOT NULL) AS model,
   arg_max(created, seq) FILTER (created IS NOT NULL) AS created, arg_max(total_tokens, seq) FILTER (total_tokens IS NOT NULL) AS total_tokens
  FROM fx_deltas GROUP BY response_id""", ("fx_deltas",))
def _(t):
    return generate.fold_deltas(t("fx_deltas"))


@query("gen11_model_catalogue", """SELECT DISTINCT user_id, event_type AS provider, concat('m', event_id%3) AS model,
   event_type <> 'error' AND event_type <> 'view' AS supports_custom, event_id%3 = 1 AS is_default, '{"t":1}' AS params FROM events""")
def _(t):
    """One catalogue document per user, with the providers and models seen in the event table."""
    m = t("events").select("user_id", F.col("event_type").alias("p"), (F.col("event_id") % 3).alias("m")).distinct()
    entry = F.concat(F.lit('"m'), F.col("m").cast("string"), F.lit('":{"t":1}'))
    models = m.groupBy("user_id", "p").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("ms"))
    custom = F.when(F.col("p") == "error", "").when(F.col("p") == "view", '"supportsCustomModel":false,').otherwise(
        '"supportsCustomModel":true,'
    )
    prov = F.concat(F.lit('"'), F.col("p"), F.lit('":{"default_model":"m1",'), custom, F.lit('"models":{'), F.col("ms"), F.lit("}}"))
    docs = models.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(prov)), ",").alias("b")).select(
        "user_id", F.concat(F.lit('{"default_provider":"x","providers":{'), F.col("b"), F.lit("}}")).alias("body")
    )
    return generate.flatten_catalogue(docs, "user_id").drop("default_model")


@query("str2_sse_lines", """SELECT l.response_id, l.seq, CASE WHEN l.seq%10=3 THEN concat('t', l.seq) ELSE concat(e.event_type, ' ') END AS delta
  FROM fx_sse l JOIN events e ON e.event_id = l.seq LEFT JOIN (SELECT response_id, min(seq) AS e FROM fx_sse WHERE line = 'data: [DONE]'
   GROUP BY response_id) d ON d.response_id = l.response_id
  WHERE l.seq%10 >= 3 AND l.line <> 'data: [DONE]' AND (d.e IS NULL OR l.seq < d.e)""", ("fx_sse",))
def _(t):
    return generate.parse_sse(t("fx_sse"))
