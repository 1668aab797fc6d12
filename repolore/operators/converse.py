"""Conversations to prompts. Messages are (conv_id, turn, role, content); ``turn`` is the 0-based list position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import text as X
from repolore.operators.ordered import join_text, whole_texts
from repolore.session import cut_lineage, fits

REQUEST_SCHEMA = (
    "repo_url string, messages array<struct<role:string,content:string>>, filePath string, type string, "
    "provider string, model string, language string, excluded_dirs string, excluded_files string, "
    "included_dirs string, included_files string"
)

PHASE_TEMPLATES = {
    "simple": "You explain the {repo_type} repository {repo_name} ({repo_url}). Answer in {language_name}.",
    "first": "Plan research on {repo_name} ({repo_type}, {repo_url}). Start with '## Research Plan'. Use {language_name}.",
    "intermediate": (
        "Continue research on {repo_name} ({repo_type}, {repo_url}), iteration {research_iteration}. "
        "Start with '## Research Update {{research_iteration}}'. Use {language_name}."
    ),
    "final": (
        "Conclude research on {repo_name} ({repo_type}, {repo_url}) after {research_iteration} iterations. "
        "Start with '## Final Conclusion'. Use {language_name}."
    ),
}


def parse_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """Request JSON to typed columns with defaults. Works on batch and streaming input."""
    r = F.from_json(body, REQUEST_SCHEMA)

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.col("_r")[name], F.lit(default)).alias(name)

    rest = [c for c in raw.columns if c != body]
    return raw.withColumn("_r", r).select(
        *rest,
        F.col("_r.repo_url").alias("repo_url"),
        F.col("_r.messages").alias("messages"),
        F.col("_r.filePath").alias("file_path"),
        field("type", "github"),
        field("provider", "google"),
        F.col("_r.model").alias("model"),
        field("language", C.DEFAULT_LANGUAGE),
        *[F.col(f"_r.{f}").alias(f) for f in ("excluded_dirs", "excluded_files", "included_dirs", "included_files")],
    )


def explode_messages(requests: DataFrame) -> DataFrame:
    return requests.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content"
    )


def pair_turns(messages: DataFrame) -> DataFrame:
    """User/assistant pairs by position: even places meet the odd place behind them.

    Joined on (conversation, position div 2), which is unique on both sides, so a huge conversation spreads over all
    tasks, and rows of the wrong role or place are dropped before the shuffle.
    """
    pair_no = F.floor(F.col("turn") / 2).alias("pair_no")
    asked = messages.where((F.col("turn") % 2 == 0) & (F.col("role") == "user"))
    replied = messages.where((F.col("turn") % 2 == 1) & (F.col("role") == "assistant"))
    return asked.select("conv_id", pair_no, F.col("content").alias("user_text")).join(
        replied.select("conv_id", pair_no, F.col("content").alias("assistant_text")), ["conv_id", "pair_no"]
    )


def turn_markup() -> Column:
    return F.concat(
        F.lit("<turn>\n<user>"), F.col("user_text"), F.lit("</user>\n<assistant>"), F.col("assistant_text"),
        F.lit("</assistant>\n</turn>\n"),
    )


def history_parts(pairs: DataFrame) -> DataFrame:
    """(conv_id, pair_no, part)"""
    return pairs.select("conv_id", "pair_no", turn_markup().alias("part"))


def render_history(pairs: DataFrame, **kw) -> DataFrame:
    """(conv_id, n_chars, history, error), in one cell: for model calls, whose prompts are cells."""
    return join_text(history_parts(pairs), ["conv_id"], ["pair_no"], "part", out="history", **kw)


def history_blocks(pairs: DataFrame, **kw) -> DataFrame:
    """(conv_id, block, history) of any length."""
    return whole_texts(history_parts(pairs), ["conv_id"], ["pair_no"], "part", out="history", **kw)


def numbered_history(pairs: DataFrame, **kw) -> DataFrame:
    """(conv_id, block, history) of any length."""
    part = F.concat(
        F.col("pair_no").cast("string"), F.lit(".\nUser: "), F.col("user_text"), F.lit("\nYou: "),
        F.col("assistant_text"), F.lit("\n"),
    )
    return whole_texts(pairs.select("conv_id", "pair_no", part.alias("part")), ["conv_id"], ["pair_no"], "part",
                       out="history", **kw)


def clean_tag(content: Column) -> Column:
    return F.when(
        content.contains(C.RESEARCH_TAG), X.strip(F.replace(content, F.lit(C.RESEARCH_TAG), F.lit("")))
    ).otherwise(content)


def request_state(messages: DataFrame) -> DataFrame:
    """One row per conversation: validity, research flag, iteration, query, phase.

    One aggregate whose partial results hold two texts per conversation, so each task sends those instead of messages.
    """
    content, lowered = F.col("content"), F.lower("content")
    original = (F.col("role") == "user") & ~lowered.contains("continue")
    agg = messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.max_by(F.struct("role", "content"), "turn").alias("last"),
        F.coalesce(F.bool_or(content.contains(C.RESEARCH_TAG)), F.lit(False)).alias("is_research"),
        F.count_if(F.col("role") == "assistant").alias("n_replies"),
        F.min_by(F.when(original, content), F.when(original, F.col("turn"))).alias("first_topic"),
    )
    last = clean_tag(F.col("last.content"))
    topic = X.strip(F.replace("first_topic", F.lit(C.RESEARCH_TAG), F.lit("")))
    resumed = F.col("is_research") & F.lower(last).contains("continue") & F.lower(last).contains("research")
    has_topic = F.coalesce(topic, F.lit("")) != ""
    return agg.select(
        "conv_id",
        F.when(F.col("last.role") != "user", 400).alias("error_code"),
        "n_messages",
        F.col("last.role").alias("last_role"),
        F.col("last.content").alias("last_content"),
        "is_research",
        F.when(F.col("is_research"), F.col("n_replies") + 1).otherwise(F.lit(1)).cast("bigint").alias("iteration"),
        F.when(resumed & has_topic, topic).otherwise(last).alias("query"),
    ).withColumn("phase", phase(F.col("is_research"), F.col("iteration")))


def validate(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Every request with its ``error_code``/``error``: no messages, or last message not from the user."""
    joined = requests.join(state.select("conv_id", "n_messages", "last_role"), "conv_id", "left")
    empty = F.col("n_messages").isNull()
    wrong = F.col("last_role") != "user"
    return (
        joined.withColumn("error_code", F.when(empty | wrong, 400).cast("bigint"))
        .withColumn("error", F.when(empty, "No messages provided").when(wrong, "Last message must be from the user"))
        .drop("n_messages", "last_role")
    )


def strip_tags(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages with the research tag removed from those equal to the conversation's last message.

    The state is checkpointed, so that AQE can split a huge conversation on the message side."""
    s = cut_lineage(state.select("conv_id", "last_role", "last_content", "is_research"))
    same = (F.col("role") == F.col("last_role")) & (F.col("content") == F.col("last_content"))
    return (
        messages.join(s, "conv_id")
        .withColumn("content", F.when(same, clean_tag(F.col("content"))).otherwise(F.col("content")))
        .select("conv_id", "turn", "role", "content", "is_research")
    )


def phase(is_research: Column, iteration: Column) -> Column:
    return (
        F.when(~is_research, "simple")
        .when(iteration == 1, "first")
        .when(iteration >= C.MAX_RESEARCH_ITERATIONS, "final")
        .otherwise("intermediate")
    )


def repo_name(repo_url: Column) -> Column:
    return F.element_at(F.split(repo_url, "/"), -1)


def system_prompt(
    phase_name: Column, repo_type: Column, repo_url: Column, language_name: Column, iteration: Column,
    templates: dict[str, str] = PHASE_TEMPLATES,
) -> Column:
    template = F.lit(None).cast("string")
    for name, t in templates.items():
        template = F.when(phase_name == name, F.lit(t)).otherwise(template)
    return X.fill(
        template,
        {
            "repo_type": repo_type, "repo_url": repo_url, "repo_name": repo_name(repo_url),
            "language_name": language_name, "research_iteration": iteration,
        },
    )


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _head(system: Column) -> Column:
    return F.concat(F.lit("/no_think "), system, F.lit("\n\n"))


def _tail(file_path: Column, file_content: Column, middle: Column, query: Column, provider: Column) -> Column:
    return F.concat(
        F.when(
            _some(file_content),
            F.concat(F.lit('<currentFileContent path="'), file_path, F.lit('">\n'), file_content,
                     F.lit("\n</currentFileContent>\n\n")),
        ).otherwise(""),
        middle,
        F.lit("<query>\n"), query, F.lit("\n</query>\n\nAssistant: "),
        F.when(provider == "ollama", " /no_think").otherwise(""),
    )


OPEN_HISTORY, CLOSE_HISTORY = "<conversation_history>\n", "</conversation_history>\n\n"


def _prompt(system: Column, history: Column, file_path: Column, file_content: Column, middle: Column, query: Column,
            provider: Column) -> Column:
    shown = F.when(_some(history), F.concat(F.lit(OPEN_HISTORY), history, F.lit(CLOSE_HISTORY))).otherwise("")
    return F.concat(_head(system), shown, _tail(file_path, file_content, middle, query, provider))


def context_block(context: Column) -> Column:
    return F.when(
        X.is_blank(context), C.NO_CONTEXT_NOTE + "\n\n"
    ).otherwise(F.concat(F.lit("<START_OF_CONTEXT>\n"), context, F.lit("\n<END_OF_CONTEXT>\n\n")))


SIMPLIFIED = C.SIMPLIFIED_NOTE + "\n\n"


def full_prompt(system, history, file_path, file_content, context, query, provider) -> Column:
    return _prompt(system, history, file_path, file_content, context_block(context), query, provider)


def simplified_prompt(system, history, file_path, file_content, query, provider) -> Column:
    return _prompt(system, history, file_path, file_content, F.lit(SIMPLIFIED), query, provider)


def prompt_blocks(requests: DataFrame, pairs: DataFrame, middle: Column, **kw) -> DataFrame:
    """(conv_id, block, prompt): the same text as ``full_prompt`` (``middle``: ``context_block``) or ``simplified_prompt``
    (``SIMPLIFIED``), with a history of any length, which is never put into one cell.

    ``requests``: conv_id, system_prompt, file_path, file_content, query, provider and what ``middle`` names."""
    c, at = F.col, F.lit(0).cast("bigint").alias("place")
    talked = pairs.groupBy("conv_id").agg(F.lit(True).alias("_talked"))
    asked = requests.join(talked, "conv_id", "left")
    tags = [F.when(c("_talked"), x).otherwise("") for x in (OPEN_HISTORY, CLOSE_HISTORY)]
    tail = _tail(c("file_path"), c("file_content"), middle, c("query"), c("provider"))
    ends = asked.select("conv_id", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), at, F.concat(_head(c("system_prompt")), tags[0]).alias("part")),
        F.struct(F.lit(2).alias("section"), at, F.concat(tags[1], tail).alias("part")),
    )))
    history = history_parts(pairs).join(requests.select("conv_id").distinct(), "conv_id", "left_semi")
    history = history.select("conv_id", F.lit(1).alias("section"), c("pair_no").cast("bigint").alias("place"), "part")
    return whole_texts(ends.unionByName(history), ["conv_id"], ["section", "place"], "part", out="prompt", **kw)


def model_parameters(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Attach ``params`` of (provider, model). An unknown model keeps its name and takes the default model's
    parameters; an unknown provider sets ``error``. ``models``: (provider, model, params, is_default), broadcast after
    a size check: requests crowd on few providers."""
    small = fits(models, 10_000)

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    named = side(models.select("provider", F.col("model").alias("_wanted"), F.col("params").alias("_own")))
    default = side(
        models.where("is_default").select(
            "provider", F.col("model").alias("_default"), F.col("params").alias("_default_params")
        )
    )
    wanted = F.coalesce(F.nullif("model", F.lit("")), F.col("_default"))
    return (
        requests.join(default, "provider", "left")
        .withColumn("_wanted", wanted)
        .join(named, ["provider", "_wanted"], "left")
        .withColumn("model", F.col("_wanted"))
        .withColumn("params", F.coalesce("_own", "_default_params"))
        .withColumn("error", F.when(F.col("_default").isNull(), "unknown provider"))
        .drop("_wanted", "_own", "_default", "_default_params")
    )


def _structure_ends(readme: Column) -> tuple[Column, Column]:
    """What stands before and after the file tree of a wiki plan's prompt."""
    ask = F.concat(F.lit("Plan a wiki for repository "), F.col("repo"), F.lit(".\n\n<file_tree>\n"))
    rest = F.concat(F.lit("\n</file_tree>\n\n<readme>\n"), F.coalesce(readme, F.lit("")),
                    F.lit("\n</readme>\n\nReply with one <wiki_structure> XML document."))
    return ask, rest


def structure_prompt(repos: DataFrame, listing: DataFrame, readmes: DataFrame, **kw) -> DataFrame:
    """(repo, prompt, tree_error): prompt asking for the repository's wiki plan, from its file tree and readme, in one cell for a
    model call. A tree that does not fit one cell gives a null prompt and a ``tree_error``; ``structure_prompt_blocks`` gives it."""
    tree = join_text(listing, ["repo"], ["file_path"], "file_path", sep="\n", out="file_tree", **kw).drop("n_chars")
    before, after = _structure_ends(F.col("readme"))
    ask = F.concat(before, F.coalesce("file_tree", F.lit("")), after)
    return (
        repos.join(tree, "repo", "left").join(readmes.select("repo", "readme"), "repo", "left")
        .select("repo", F.when(F.col("error").isNull(), ask).alias("prompt"), F.col("error").alias("tree_error"))
    )


def structure_prompt_blocks(repos: DataFrame, listing: DataFrame, readmes: DataFrame, **kw) -> DataFrame:
    """(repo, block, prompt): the prompt of ``structure_prompt`` with a file tree of any length."""
    paths = listing.where("file_path IS NOT NULL").join(repos.select("repo").distinct(), "repo", "left_semi")
    first = paths.groupBy("repo").agg(F.min("file_path").alias("_first"))
    before, after = _structure_ends(F.col("readme"))
    ends = repos.select("repo").distinct().join(readmes.select("repo", "readme"), "repo", "left").select("repo", F.inline(F.array(
        F.struct(F.lit(0).alias("section"), F.lit("").alias("place"), F.lit(False).alias("more"), before.alias("part")),
        F.struct(F.lit(2).alias("section"), F.lit("").alias("place"), F.lit(False).alias("more"), after.alias("part")),
    )))
    # each path but the first of its tree follows a line feed; equal paths are told apart by their number
    tree = paths.groupBy("repo", "file_path").agg(F.count("*").alias("n")).join(first, "repo")
    tree = tree.select("repo", F.col("file_path").alias("place"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("i"), "_first")
    more = (F.col("place") != F.col("_first")) | (F.col("i") > 1)
    tree = tree.select("repo", F.lit(1).alias("section"), "place", more.alias("more"),
                       F.concat(F.when(more, "\n").otherwise(""), "place").alias("part"))
    return whole_texts(ends.unionByName(tree), ["repo"], ["section", "place", "more"], "part", out="prompt", **kw)


def file_list_markup(file_paths: Column, link) -> Column:
    """Bullet list of source links; ``link`` maps a path column to its address."""
    return F.array_join(
        F.transform(file_paths, lambda p: F.concat(F.lit("- ["), p, F.lit("]("), link(p), F.lit(")"))), "\n"
    )


def page_prompt(title: Column, file_list: Column) -> Column:
    return F.concat(
        F.lit("Write the wiki page '"), title, F.lit("' in Markdown.\n\n<details>\n<summary>Relevant source files"
              "</summary>\n\n"), file_list, F.lit("\n</details>\n\n# "), title,
    )
