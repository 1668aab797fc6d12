"""Model calls as table transformations: requests out, responses in, usage, deltas."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolore import constants as C
from repolore.functions import text as X
from repolore.operators.embed import slices, with_columns
from repolore.operators.ordered import whole_texts
from repolore.session import cut_lineage, keep_small

RESPONSE_FIELDS = [
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
]

FIRST_WAIT = 0.1  # seconds
RETRY_WINDOW = 5.0
SLICE = 32  # rows answered at once
CALLS_PER_SLICE = 16  # times the calls that may be open


class Reply(NamedTuple):
    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class Generator(Protocol):
    """Anything that answers one prompt. An exception becomes the row's ``error``."""

    def __call__(self, prompt: str) -> Reply: ...


class EchoGenerator:
    """Deterministic stand-in: echoes the first line; refuses prompts above ``max_tokens`` words."""

    def __init__(self, max_tokens: int | None = None, poison: str | None = None):
        self.max_tokens, self.poison = max_tokens, poison

    def __call__(self, prompt: str) -> Reply:
        n = len(prompt.split())
        if self.poison and self.poison in prompt:
            raise RuntimeError("model unavailable")
        if self.max_tokens is not None and n > self.max_tokens:
            raise ValueError(f"prompt exceeds the maximum context length of {self.max_tokens}")
        answer = prompt.split("\n", 1)[0]
        return Reply(f"echo: {answer}", n, len(answer.split()) + 1)


class DigestGenerator:
    """Deterministic stand-in: answers with the prompt's SHA-256; refuses prompts without ``needs`` as too long."""

    def __init__(self, needs: str = ""):
        self.needs = needs

    def __call__(self, prompt: str) -> Reply:
        if self.needs not in prompt:
            raise ValueError("prompt exceeds the maximum context length")
        return Reply(hashlib.sha256(prompt.encode("utf-8")).hexdigest(), len(prompt.split()), 1)


class FolderPlanner:
    """Deterministic stand-in for a wiki planner: one page per top folder of the file tree in the prompt."""

    def __call__(self, prompt: str) -> Reply:
        from xml.sax.saxutils import escape

        tree = prompt.split("<file_tree>\n", 1)[1].split("\n</file_tree>", 1)[0]
        folders: dict[str, list[str]] = {}
        for path in tree.split("\n"):
            folders.setdefault(path.split("/", 1)[0], []).append(path)
        pages = [
            f"<page id='p{i}'><title>{escape(f'{top}: {len(found)} files')}</title><importance>{'low' if i else 'high'}</importance>"
            f"<relevant_files><file_path>{escape(min(found))}</file_path></relevant_files></page>"
            for i, (top, found) in enumerate(sorted(folders.items()))
        ]
        plan = f"<wiki_structure><title>Wiki</title><description>d</description><pages>{''.join(pages)}</pages></wiki_structure>"
        return Reply(plan, len(prompt.split()), len(pages))


class Pace:
    """Call starts of one task, no closer than ``gap`` seconds."""

    def __init__(self, gap: float):
        self.gap, self.next, self.lock = gap, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            start = max(self.next, time.monotonic())
            self.next = start + self.gap
        time.sleep(max(0.0, start - time.monotonic()))


def generate(
    df: DataFrame, make_generator: Callable[[], Generator], prompt: str = "prompt", retries: int = 0,
    parallel: int | None = None, in_flight: int = 1, calls_per_second: float | None = None,
) -> DataFrame:
    """Add response, error and token counts; rows keep their order.

    A task has up to ``in_flight`` calls open at once; the generator must allow that. ``parallel`` bounds the tasks (number of
    partitions), so at most ``parallel * in_flight`` calls are open in the job. ``calls_per_second`` is the job's limit, shared out
    evenly among the tasks, and so needs ``parallel``. A failed call is made again up to ``retries`` times, after waits
    that double, within ``RETRY_WINDOW`` seconds of waiting. Each slice of rows is answered before the next is read.
    """
    if calls_per_second and not parallel:
        raise ValueError("a limit for the job needs a number of tasks to share it")
    gap = parallel / calls_per_second if calls_per_second else 0.0
    schema = T.StructType([f for f in df.schema.fields] + RESPONSE_FIELDS)

    def answer(gen: Generator, pace: Pace, text: str | None) -> tuple:
        failure = "empty prompt"
        if text:
            wait, left = FIRST_WAIT, RETRY_WINDOW
            for attempt in range(retries + 1):
                if attempt:
                    if left <= 0:
                        break
                    time.sleep(min(wait, left))
                    wait, left = 2 * wait, left - wait
                pace.wait()
                try:
                    r = gen(text)
                    return r.text, None, r.prompt_tokens, r.completion_tokens
                except Exception as e:
                    failure = str(e) or type(e).__name__
        return None, failure, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gen, pace = make_generator(), Pace(gap)
        with ThreadPoolExecutor(in_flight) as pool:
            for part in slices(batches, max(SLICE, CALLS_PER_SLICE * in_flight)):  # prompts may be long: few are Python objects at once
                rows = list(pool.map(partial(answer, gen, pace), part.column(prompt).to_pylist()))
                response, error, asked, answered = zip(*rows, strict=True)
                yield with_columns(
                    part, response=pa.array(response, pa.string()), error=pa.array(error, pa.string()),
                    prompt_tokens=pa.array(asked, pa.int64()), completion_tokens=pa.array(answered, pa.int64()),
                )

    return (df.repartition(parallel) if parallel else df).mapInArrow(run, schema)


ANSWER_SCHEMA = "prompt_hash string, response string, error string, prompt_tokens bigint, completion_tokens bigint"


def generate_once(
    df: DataFrame, make_generator: Callable[[], Generator], store: str, prompt: str = "prompt", waves: int = 8, **kw
) -> DataFrame:
    """As ``generate``, with answers kept below ``store`` by prompt hash: no prompt is answered twice, also not by a job that starts again.

    Equal prompts are one call. Prompts are dealt to ``waves`` by their hash and each wave is written before the next begins, so an
    executor that is lost repeats at most the calls of its tasks in one wave. Failed calls are not kept, but come back with their ``error``.
    """
    spark = df.sparkSession
    hashed = df.withColumn("prompt_hash", F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256))
    asked = cut_lineage(hashed.groupBy("prompt_hash").agg(F.first(prompt).alias("prompt")))
    for wave in range(waves):
        known = _answers(spark, store).select("prompt_hash")
        mine = asked.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)) == wave).join(known, "prompt_hash", "left_anti")
        out = generate(mine, make_generator, "prompt", **kw).drop("prompt")
        out.write.mode("overwrite").parquet(f"{store}/last/wave={wave}")
        spark.read.schema(ANSWER_SCHEMA).parquet(f"{store}/last/wave={wave}").where("error IS NULL").write.mode("append").parquet(f"{store}/answers")
    names = [f.name for f in RESPONSE_FIELDS]
    failed = spark.read.schema(ANSWER_SCHEMA + ", wave int").parquet(f"{store}/last").where("error IS NOT NULL").drop("wave")
    answers = _answers(spark, store).unionByName(failed)
    return hashed.join(answers, "prompt_hash", "left").select(*df.columns, *names)


def _answers(spark: SparkSession, store: str) -> DataFrame:
    """One answer per prompt; a wave that was written twice has each twice."""
    try:
        kept = spark.read.schema(ANSWER_SCHEMA).parquet(f"{store}/answers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWER_SCHEMA)
    return kept.dropDuplicates(["prompt_hash"])


def is_token_limit(error: Column) -> Column:
    return F.coalesce(X.contains_any(error, C.TOKEN_LIMIT_ERRORS), F.lit(False))


def redrive(answers: DataFrame, fallback_prompt: Column, make_generator: Callable[[], Generator], **kw) -> DataFrame:
    """Second pass over rows that hit the token limit, with ``fallback_prompt``; other rows are kept as they are.

    Pass ``answers`` read from a written table or checkpoint, so the first pass is not repeated.
    """
    failed = is_token_limit(F.col("error"))
    names = [f.name for f in RESPONSE_FIELDS]
    first = answers.where(~failed).withColumn("attempt", F.lit(1).cast("bigint"))
    again = generate(answers.where(failed).withColumn("prompt", fallback_prompt).drop(*names), make_generator, **kw)
    return first.unionByName(again.withColumn("attempt", F.lit(2).cast("bigint")))


def reply_or_message(response: Column, error: Column) -> Column:
    """What the reader sees: the response, or the error as text."""
    return F.when(error.isNull(), response).otherwise(F.concat(F.lit("\nError: "), error))


# --- payloads and responses per vendor family ----------------------------------------------------------------


def vendor_family(model_id: Column) -> Column:
    return F.when(model_id.contains("."), F.element_at(F.split(model_id, r"\."), 1)).otherwise("amazon")


def payload(family: Column, prompt: Column, messages: Column | None = None) -> Column:
    """Request body as JSON text in the vendor's form."""

    def text_part(t: Column) -> Column:
        return F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))

    single = F.array(F.struct(F.lit("user").alias("role"), text_part(prompt).alias("content")))
    if messages is None:
        chat = single
    else:
        many = F.transform(
            messages,
            lambda m: F.struct(
                F.when(m["role"] == "user", "user").otherwise("assistant").alias("role"),
                text_part(F.coalesce(m["content"], F.lit(""))).alias("content"),
            ),
        )
        chat = F.when(F.coalesce(F.size(messages), F.lit(0)) > 0, many).otherwise(single)
    anthropic = F.to_json(
        F.struct(
            F.lit(C.ANTHROPIC_VERSION).alias("anthropic_version"), chat.alias("messages"),
            F.lit(C.MAX_ANSWER_TOKENS).alias("max_tokens"),
        )
    )
    amazon = F.to_json(
        F.struct(
            prompt.alias("inputText"),
            F.struct(
                F.lit(C.MAX_ANSWER_TOKENS).alias("maxTokenCount"), F.array().cast("array<string>").alias("stopSequences"),
                F.lit(C.TEMPERATURE).alias("temperature"), F.lit(C.TOP_P).alias("topP"),
            ).alias("textGenerationConfig"),
        )
    )
    cohere = F.to_json(
        F.struct(
            prompt.alias("prompt"), F.lit(C.MAX_ANSWER_TOKENS).alias("max_tokens"), F.lit(C.TEMPERATURE).alias("temperature"),
            F.lit(C.TOP_P).alias("p"),
        )
    )
    ai21 = F.to_json(
        F.struct(
            prompt.alias("prompt"), F.lit(C.MAX_ANSWER_TOKENS).alias("maxTokens"), F.lit(C.TEMPERATURE).alias("temperature"),
            F.lit(C.TOP_P).alias("topP"),
        )
    )
    return (
        F.when(family == "anthropic", anthropic)
        .when(family == "amazon", amazon)
        .when(family == "cohere", cohere)
        .when(family == "ai21", ai21)
        .otherwise(F.to_json(F.struct(prompt.alias("prompt"))))
    )


def response_text(family: Column, raw: Column) -> Column:
    """Generated text from a response body."""

    def at(p: str) -> Column:
        return F.get_json_object(raw, p)

    def or_empty(p: str) -> Column:
        return F.coalesce(at(p), F.lit(""))

    return (
        F.when(family == "anthropic", or_empty("$.content[0].text"))
        .when(family == "amazon", or_empty("$.results[0].outputText"))
        .when(family == "cohere", or_empty("$.generations[0].text"))
        .when(family == "ai21", or_empty("$.completions[0].data.text"))
        .when(at("$.choices").isNotNull(), F.coalesce(at("$.choices[0].message.content"), at("$.choices[0].text")))
        .otherwise(F.coalesce(at("$.text"), at("$.content"), at("$.output"), at("$.completion"), raw))
    )


def usage(raw: Column) -> list[Column]:
    return [
        F.get_json_object(raw, f"$.usage.{f}").cast("bigint").alias(f)
        for f in ("completion_tokens", "prompt_tokens", "total_tokens")
    ]


def usage_totals(completions: DataFrame) -> DataFrame:
    """Calls, calls without usage and token sums per (provider, model)."""
    u = completions.select("provider", "model", *usage(F.col("raw")))
    return u.groupBy("provider", "model").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("total_tokens").isNull()).alias("without_usage"),
        *[F.sum(c).alias(c) for c in ("completion_tokens", "prompt_tokens", "total_tokens")],
    )


COMPLETION_SCHEMA = (
    "choices array<struct<message:struct<content:string>,"
    "logprobs:struct<content:array<struct<token:string,logprob:double>>>>>"
)


def choices(completions: DataFrame) -> DataFrame:
    """One row per choice."""
    parsed = completions.select("id", F.from_json("raw", COMPLETION_SCHEMA)["choices"].alias("c"))
    return parsed.select("id", F.posexplode("c").alias("choice", "m")).select(
        "id", F.col("choice").cast("bigint").alias("choice"), F.col("m.message.content").alias("content")
    )


def token_logprobs(completions: DataFrame) -> DataFrame:
    """One row per (choice, position)."""
    parsed = completions.select("id", F.from_json("raw", COMPLETION_SCHEMA)["choices"].alias("c"))
    per_choice = parsed.select("id", F.posexplode("c").alias("choice", "m"))
    return per_choice.select("id", "choice", F.posexplode("m.logprobs.content").alias("pos", "t")).select(
        "id", F.col("choice").cast("bigint").alias("choice"), F.col("pos").cast("bigint").alias("pos"),
        F.col("t.token").alias("token"), F.col("t.logprob").alias("logprob"),
    )


# --- streamed text -------------------------------------------------------------------------------------------


def keep_delta(delta: Column) -> Column:
    """False for null, empty and protocol-noise deltas."""
    return (
        (F.coalesce(delta, F.lit("")) != "")
        & ~F.startswith(delta, F.lit("model="))
        & ~F.startswith(delta, F.lit("created_at="))
    )


def drop_think_tags(delta: Column) -> Column:
    return F.replace(F.replace(delta, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))


def sse_payload(line: Column) -> Column:
    trimmed = X.strip(line)
    return F.when(F.startswith(trimmed, F.lit("data: ")), F.substr(trimmed, F.lit(7)))


def sse_done(line: Column) -> Column:
    return F.coalesce(sse_payload(line) == "[DONE]", F.lit(False))


def sse_delta(line: Column) -> Column:
    """Text carried by one event line; null for comments, blanks, the end mark and broken JSON."""
    p = sse_payload(line)
    content = F.nullif(F.get_json_object(p, "$.choices[0].delta.content"), F.lit(""))
    return F.coalesce(content, F.get_json_object(p, "$.choices[0].text"))


def parse_sse(lines: DataFrame) -> DataFrame:
    """(response_id, seq, delta) for event lines before the response's end mark.

    The end position is one number per response, so only ids and numbers are aggregated. They are kept first, so that the
    lines of a hot response stay in place (few ends) or are split by AQE (many).
    """
    ends = keep_small(lines.where(sse_done(F.col("line"))).groupBy("response_id").agg(F.min("seq").alias("_end")))
    deltas = lines.select("response_id", "seq", sse_delta(F.col("line")).alias("delta")).where("delta IS NOT NULL")
    return (
        deltas.join(ends, "response_id", "left")
        .where(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
        .drop("_end")
    )


def fold_deltas(deltas: DataFrame, **kw) -> DataFrame:
    """Completions per response: the text in ``seq`` order as blocks (``whole_texts``), with the last non-empty id, model, created and
    usage on each; almost every response is one block. ``n_chars`` is the block's."""

    def last(name: str) -> Column:
        ok = F.col(name).isNotNull() & (F.col(name).cast("string") != "")
        return F.max_by(F.when(ok, F.col(name)), F.when(ok, F.col("seq"))).alias(name)

    meta = deltas.groupBy("response_id").agg(*[last(c) for c in ("id", "model", "created", "total_tokens")])
    parts = deltas.select("response_id", "seq", F.coalesce("delta", F.lit("")).alias("part"))
    texts = whole_texts(parts, ["response_id"], ["seq"], "part", out="content", **kw)
    return meta.join(texts.withColumn("n_chars", F.length("content").cast("bigint")), "response_id")


# --- catalogue, images, tagged prompts ---------------------------------------------------------------------------

CATALOGUE_SCHEMA = (
    "providers map<string,struct<default_model:string,supportsCustomModel:boolean,models:map<string,string>>>"
)


def flatten_catalogue(catalogues: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Model catalogue JSON per ``key`` to (provider, model, is_default, supports_custom, params)."""
    providers = catalogues.select(
        key, F.explode(F.from_json(body, CATALOGUE_SCHEMA)["providers"]).alias("provider", "p")
    )
    return providers.select(
        key, "provider", "p.default_model",
        F.coalesce("p.supportsCustomModel", F.lit(False)).alias("supports_custom"),
        F.explode("p.models").alias("model", "params"),
    ).withColumn("is_default", F.col("model") == F.col("default_model"))


def split_tagged_prompt(prompt: Column, otherwise_role: str = "user") -> Column:
    """``<START_OF_SYSTEM_PROMPT>…`` text to an array of (role, content); one message when tags are absent."""
    s = X.SPACE
    pattern = (
        rf"(?s)^<START_OF_SYSTEM_PROMPT>[{s}]*(.*?)[{s}]*<END_OF_SYSTEM_PROMPT>[{s}]*"
        rf"<START_OF_USER_PROMPT>[{s}]*(.*?)[{s}]*<END_OF_USER_PROMPT>"
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system, user = F.regexp_extract(prompt, pattern, 1), F.regexp_extract(prompt, pattern, 2)
    both = F.array(message("system", system), message("user", user))
    return F.when(prompt.rlike(pattern) & (system != "") & (user != ""), both).otherwise(
        F.array(message(otherwise_role, prompt))
    )


def image_part(source: Column, content: Column, detail: str = "auto") -> Column:
    """Message part for an image: a web address as it is, otherwise the bytes as a data address."""
    web = F.startswith(source, F.lit("http://")) | F.startswith(source, F.lit("https://"))
    one_line = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))  # Spark breaks base64 into 76-character lines
    url = F.when(web, source).otherwise(F.concat(F.lit("data:image/jpeg;base64,"), one_line))
    return F.struct(
        F.lit("image_url").alias("type"), F.struct(url.alias("url"), F.lit(detail).alias("detail")).alias("image_url")
    )
