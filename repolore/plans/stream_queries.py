"""Streams over the given tables, run to the end of the available data; results are read back from what they wrote."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.operators import converse, derive, generate
from repolore.operators.ordered import whole_texts
from repolore.plans.converse_queries import _STATE
from repolore.plans.generate_queries import _FIRST
from repolore.plans.registry import query
from repolore.plans.derive_queries import _COMPLETE, _TYPE
from repolore.plans import vector_queries as V
from repolore.session import scratch_dir
from repolore.streaming import assemble, jobs, research


def _finish(q, spark, path):
    q.awaitTermination()
    return spark.read.parquet(path)


def _paths(t, name):
    jobs.use_rocksdb(t.spark)
    base = scratch_dir(t.spark, name)
    return f"{base}/out", f"{base}/state"


_SSE_TEXT = """deltas AS (SELECT l.response_id, l.seq, CASE WHEN l.seq%10=3 THEN concat('t', l.seq) ELSE concat(e.event_type, ' ') END AS delta
   FROM fx_sse l JOIN events e ON e.event_id = l.seq LEFT JOIN (SELECT response_id, min(seq) AS e FROM fx_sse WHERE line = 'data: [DONE]'
   GROUP BY response_id) d ON d.response_id = l.response_id
  WHERE l.seq%10 >= 3 AND l.line <> 'data: [DONE]' AND (d.e IS NULL OR l.seq < d.e))"""


def _half_lines(t):
    """Event lines cut in two, as a network delivers them, numbered per response and spread over files out of order."""
    lines = t("fx_sse")
    half = F.floor(F.length("line") / 2).cast("int")
    place = (F.col("seq") - F.col("response_id") * 200) * 2
    chunks = lines.select(
        "response_id",
        F.inline(
            F.array(
                F.struct(place.alias("seq"), F.substr("line", F.lit(1), half).alias("data")),
                F.struct((place + 1).alias("seq"), F.concat(F.substr("line", half + 1), F.lit("\n")).alias("data")),
            )
        ),
    )
    path = scratch_dir(t.spark, "chunks")
    chunks.withColumn("file", F.pmod(F.hash("response_id", "seq"), F.lit(4))).repartition(4, "file").drop("file").write.parquet(path)
    return t.spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("str1_delta_assembly", """SELECT response_id, 0::BIGINT AS block, string_agg(coalesce(delta, ''), '' ORDER BY seq) AS text
   FROM fx_deltas GROUP BY response_id""",
       ("fx_deltas",))
def _(t):
    out, state = _paths(t, "str1")
    segs = assemble.segments(t.stream("fx_deltas"))
    rows = _finish(jobs.write_batches(segs, out, state), t.spark, out)
    return whole_texts(rows, ["response_id"], ["from_seq"], "text")


@query("str2_sse_chunks", "SELECT response_id, seq, delta FROM deltas", ("fx_sse",), ctes=_SSE_TEXT)
def _(t):
    out, state = _paths(t, "str2")
    rows = _finish(jobs.write_batches(assemble.parse_chunks(_half_lines(t)), out, state), t.spark, out)
    return rows.select("response_id", (F.floor((F.col("seq") - 1) / 2) + F.col("response_id") * 200).alias("seq"), "delta")


def _answer_parts(t, a=None):
    """Each answer in three deltas (conv_id, turn, seq, delta)."""
    a = t.stream("fx_responses") if a is None else a
    third = F.floor(F.length("content") / 3).cast("int")
    return a.select(
        "conv_id", F.col("seq").alias("turn"),
        F.posexplode(
            F.array(F.substr("content", F.lit(1), third), F.substr("content", third + 1, third), F.substr("content", third * 2 + 1))
        ).alias("pos", "delta"),
    ).withColumn("seq", F.col("pos").cast("bigint"))


@query("str3_live_stages", f"""SELECT conv_id, iteration, type, CASE type WHEN 'plan' THEN 'Research Plan' WHEN 'update' THEN
   concat('Research Update ', iteration) ELSE 'Final Conclusion' END AS title, content
   FROM (SELECT *, {_TYPE} AS type FROM fx_responses) WHERE type IS NOT NULL""", ("fx_responses",))
def _(t):
    """Each answer arrives in three parts; a stage is logged when its text shows it."""
    out, state = _paths(t, "str3")
    parts = _answer_parts(t)
    growing = assemble.growing_text(parts, keys=["conv_id", "turn"]).select(
        "conv_id", F.floor((F.col("turn") + 1) / 2).alias("iteration"), "seq", "text"
    )
    log = _finish(jobs.live_stages(growing, out, state), t.spark, out)
    return derive.upsert_stages(log).drop("first_seq")


@query("str3_stage_runs", f"""SELECT conv_id, iteration, type, CASE type WHEN 'plan' THEN 'Research Plan' WHEN 'update' THEN
   concat('Research Update ', iteration) ELSE 'Final Conclusion' END AS title, 0::BIGINT AS block, content
   FROM (SELECT *, {_TYPE} AS type FROM fx_responses) WHERE type IS NOT NULL""", ("fx_responses",))
def _(t):
    """The stages again, from runs that hold each text once, over several micro-batches with parts out of order."""
    out, state = _paths(t, "str3-runs")
    path = scratch_dir(t.spark, "parts")
    parts = _answer_parts(t, t("fx_responses")).withColumn("iteration", F.floor((F.col("turn") + 1) / 2))
    parts.withColumn("file", F.pmod(F.hash("conv_id", "turn", "seq"), F.lit(3))).repartition(3, "file").drop("file").write.parquet(path)
    stream = t.spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    runs = assemble.stage_runs(stream, keys=["conv_id", "turn", "iteration"])
    log = _finish(jobs.write_batches(runs, out, state), t.spark, out).drop("batch")
    return derive.stage_texts(log, ["conv_id", "turn", "iteration"]).drop("turn", "first_seq")


@query("str4_streaming_retrieval", """SELECT query_id, concat(chr(10), chr(10), '----------', string_agg(part, chr(10)||chr(10) ORDER BY first_rank))
   AS context FROM parts GROUP BY query_id""", V._FX, ctes=V._HITS + ", " + V._CONTEXT)
def _(t):
    out, state = _paths(t, "str4")
    first = t.stream("conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"))
    requests = first.join(t("fx_queries"), "query_id")
    return _finish(jobs.live_contexts(requests, t("fx_chunk_vectors"), out, state), t.spark, out).drop("batch")


@query("str5_in_flight_once", """SELECT DISTINCT user_id AS wiki_id, concat(event_type, event_id%7) AS page_id FROM events""")
def _(t):
    out, state = _paths(t, "str5")
    requests = t.stream("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("wiki_id"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("page_id")
    )
    q = jobs.write_batches(jobs.in_flight_once(requests, "400 days"), out, state)
    return _finish(q, t.spark, out).select("wiki_id", "page_id")


@query("str5_released_pages", """SELECT user_id AS wiki_id, event_type AS page_id, event_id AS seq FROM (SELECT *,
   lag(event_id%3 = 2) OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts::TIMESTAMP), event_id) AS before FROM events)
  WHERE event_id%3 <> 2 AND coalesce(before, true)""")
def _(t):
    """A third of the events finish the page that the others ask for; a hold outlives all of them."""
    out, state = _paths(t, "str5")
    events = t.stream("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").alias("wiki_id"),
        F.col("event_type").alias("page_id"), F.when(F.col("event_id") % 3 == 2, "finish").otherwise("request").alias("kind"),
    )
    q = jobs.write_batches(jobs.in_flight(events, 4_000 * 86_400_000), out, state)
    return _finish(q, t.spark, out).select("wiki_id", "page_id", "seq")


def _round_prompts(state):
    system = converse.system_prompt(
        F.col("phase"), F.lit("github"), F.lit("https://github.com/o/r"), F.lit("English"), F.col("iteration")
    )
    return state.select("conv_id", F.concat(system, F.lit("\n"), F.col("query")).alias("prompt"))


@query("str6_research_rounds", """SELECT conv_id, i AS iteration, CASE WHEN i = 1 THEN 'first' WHEN i >= 5 THEN 'final' ELSE 'intermediate' END AS phase,
   i >= 5 AS complete, NULL::VARCHAR AS error FROM phased, unnest(range(iteration, greatest(iteration, 5)+1)) u(i)
   WHERE is_research AND last_role = 'user'""", ("fx_messages",), ctes=_STATE)
def _(t):
    out = research.run_rounds(t("fx_messages"), _round_prompts, generate.EchoGenerator)
    return out.select("conv_id", "iteration", "phase", "complete", "error")


@query("str6_next_steps", f"""SELECT conv_id, seq, k AS iteration, k >= 5 OR coalesce(done, false) AS complete,
   CASE WHEN k >= 5 OR coalesce(done, false) THEN NULL ELSE '{C.CONTINUE_MESSAGE}' END AS next_message
  FROM (SELECT *, row_number() OVER w AS k, count(*) FILTER (done) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
   AND 1 PRECEDING) AS over FROM (SELECT *, {_COMPLETE} AS done FROM fx_responses) WINDOW w AS (PARTITION BY conv_id ORDER BY seq))
  WHERE k <= 5 AND over = 0""", ("fx_responses",))
def _(t):
    out, state = _paths(t, "str6")
    q = jobs.write_batches(research.next_steps(t.stream("fx_responses")), out, state)
    return _finish(q, t.spark, out).drop("batch")


@query("str7_failure_rows", f"""SELECT doc_id, CASE WHEN contains(text, 'the ') THEN concat(chr(10), 'Error: model unavailable')
   ELSE concat('echo: ', {_FIRST}) END AS shown FROM documents""")
def _(t):
    out, state = _paths(t, "str7")
    prompts = t.stream("documents").select("doc_id", F.col("text").alias("prompt"))
    make = partial(generate.EchoGenerator, None, "the ")
    return _finish(jobs.live_answers(prompts, make, out, state), t.spark, out).select("doc_id", "shown")
