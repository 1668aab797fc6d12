"""Files to typed documents to word chunks. Every table is keyed by ``repo``."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import paths, text

TREE_SCHEMA = "array<struct<type:string,path:string>>"


def default_excluded_dirs() -> Column:
    return paths.strings(C.EXCLUDED_DIRS)


def default_excluded_files() -> Column:
    return paths.strings(C.EXCLUDED_FILES)


def exclude_paths(files: DataFrame, dirs: Column | None = None, names: Column | None = None) -> DataFrame:
    d = default_excluded_dirs() if dirs is None else dirs
    n = default_excluded_files() if names is None else names
    return files.where(~paths.is_excluded(F.col("file_path"), d, n))


def include_paths(files: DataFrame, dirs: Column, names: Column) -> DataFrame:
    return files.where(paths.is_included(F.col("file_path"), dirs, names))


def type_files(files: DataFrame) -> DataFrame:
    """Known, non-hidden file types with their code and implementation flags."""
    p = F.col("file_path")
    return files.where(paths.is_known_type(p) & ~paths.is_hidden(p)).withColumns(
        {
            "type": paths.extension(p),
            "is_code": paths.is_code(p),
            "is_implementation": paths.is_implementation(p),
            "title": p,
        }
    )


def cap_tokens(files: DataFrame, count=text.approx_tokens) -> DataFrame:
    """Keep code up to 81,920 and other text up to 8,192 tokens; adds ``token_count``."""
    return files.withColumn("token_count", count(F.col("text"))).where(
        F.col("token_count") <= paths.token_cap(paths.is_code(F.col("file_path")))
    )


def to_documents(
    files: DataFrame,
    excluded_dirs: Column | None = None,
    excluded_files: Column | None = None,
    included_dirs: Column | None = None,
    included_files: Column | None = None,
    count=text.approx_tokens,
) -> DataFrame:
    """Path rules first (cheap, pushed towards the scan), then typing, then the token cap."""
    excl_d = paths.union_lists(default_excluded_dirs(), excluded_dirs if excluded_dirs is not None else F.lit(None))
    excl_f = paths.union_lists(default_excluded_files(), excluded_files if excluded_files is not None else F.lit(None))
    if included_dirs is None and included_files is None:
        kept = exclude_paths(files, excl_d, excl_f)
    else:
        incl_d = paths.strings([]) if included_dirs is None else included_dirs
        incl_f = paths.strings([]) if included_files is None else included_files
        kept = files.where(paths.keep_path(F.col("file_path"), excl_d, excl_f, incl_d, incl_f))
    return cap_tokens(type_files(kept), count)


#: Numbers for the chunks of one document. A cell holds below 2 ** 31 bytes, so at most 2 ** 30 words, and chunks begin
#: ``CHUNK_WORDS - CHUNK_OVERLAP`` (250) words apart: at most 4.3 million of them.
MAX_CHUNKS = 1 << 23


def chunk_id(doc_id: str = "doc_id", ord: str = "ord") -> Column:
    """One number per (document, chunk): no two are alike below ``MAX_CHUNKS`` chunks and 2 ** 40 documents, and others are an error."""
    fits = (F.col(ord) < MAX_CHUNKS) & (F.abs(F.col(doc_id)) < 1 << 40)
    number = F.col(doc_id).cast("bigint") * MAX_CHUNKS + F.col(ord)
    return F.when(fits, number).when(F.col(doc_id).isNotNull(), F.raise_error(F.lit("chunk numbers are used up")).cast("bigint"))


def chunk_words(docs: DataFrame, size: int = C.CHUNK_WORDS, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping word windows: one row per chunk with ``ord``; all other columns are copied."""
    step = size - overlap
    words = docs.withColumn("_w", F.split("text", " ")).drop("text")
    return (
        words.withColumn("ord", F.explode(F.sequence(F.lit(0), text.chunk_count(F.size("_w"), size, overlap) - 1)))
        .withColumn("text", F.array_join(F.slice("_w", F.col("ord") * step + 1, F.lit(size)), " "))
        .drop("_w")
    )


def list_tree(files: DataFrame) -> DataFrame:
    """Paths shown in a repository listing, one row each. Order by (repo, file_path) when writing."""
    return files.where(paths.is_listed(F.col("file_path"))).select("repo", "file_path")


def pick_readme(files: DataFrame) -> DataFrame:
    """At most one non-empty readme per repository: least deep, then by path."""
    p = F.col("file_path")
    found = files.where(
        (F.lower(paths.name(p)) == "readme.md") & paths.is_listed(p) & (F.coalesce(F.col("text"), F.lit("")) != "")
    )
    order = F.struct(F.size(F.split(p, "/")).alias("depth"), p)
    return found.groupBy("repo").agg(
        F.min_by("file_path", order).alias("file_path"), F.min_by("text", order).alias("readme")
    )


def explode_tree_dump(dumps: DataFrame) -> DataFrame:
    """Saved listing responses (repo, page, json) to file rows (repo, page, pos, path)."""
    return (
        dumps.select("repo", "page", F.posexplode(F.from_json("json", TREE_SCHEMA)).alias("pos", "e"))
        .where(F.col("e.type").isin("blob", "commit_file"))
        .select("repo", "page", F.col("pos").cast("bigint").alias("pos"), F.col("e.path").alias("path"))
    )


def decode_contents(payloads: DataFrame) -> DataFrame:
    """Content responses (``body``) to ``text`` or ``error``. ``provider`` says which shape the body has."""
    body = F.col("body")

    def field(f: str) -> Column:
        return F.get_json_object(body, f"$.{f}")

    b64 = F.replace(field("content"), F.lit("\n"), F.lit(""))
    decoded = F.try_to_binary(b64, F.lit("base64"))
    as_text = F.try_validate_utf8(decoded.cast("string"))
    github_error = (
        F.when(
            field("message").isNotNull() & field("documentation_url").isNotNull(),
            F.concat(F.lit("API error: "), field("message")),
        )
        .when(field("content").isNull() | field("encoding").isNull(), "file content not found")
        .when(field("encoding") != "base64", F.concat(F.lit("unexpected encoding: "), field("encoding")))
        .when(as_text.isNull(), "undecodable content")
    )
    gitlab_error = F.when(
        F.startswith(body, F.lit("{")) & body.contains('"message":') & field("message").isNotNull(),
        F.concat(F.lit("API error: "), field("message")),
    )
    github = F.col("provider") == "github"
    error = F.when(github, github_error).when(F.col("provider") == "gitlab", gitlab_error)
    return payloads.withColumn("error", error).withColumn(
        "text", F.when(F.col("error").isNull(), F.when(github, as_text).otherwise(body))
    )


_ENCODERS: dict = {}


def _encoder(ranks: str, pattern: str, special: Sequence[str]):
    """The encoder of a rank file, once per worker process; None where the file cannot be read."""
    if ranks not in _ENCODERS:
        try:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            names = {s: len(table) + i for i, s in enumerate(special)}
            _ENCODERS[ranks] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=names)
        except (ImportError, OSError, ValueError):
            _ENCODERS[ranks] = None
    return _ENCODERS[ranks]


def count_tokens(
    docs: DataFrame, ranks: str | None, pattern: str, special: Sequence[str] = ("<|endoftext|>",), text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``token_count`` and ``counted_by`` ('vocabulary' or 'length').

    Tokens of the whole text under the rank file ``ranks`` (on every executor). As in the original, a text that cannot be encoded
    counts length / 4: one that holds the string of a special token, or any text where the vocabulary cannot be read.
    A null text has a null count. Each row is counted where it lies; nothing is shuffled."""
    if ranks is None:
        exact = F.lit(None).cast("bigint")
    else:

        @F.pandas_udf("bigint")
        def counted(texts: pd.Series) -> pd.Series:
            encoder = _encoder(ranks, pattern, special)

            def one(t):
                try:
                    return None if encoder is None or t is None else len(encoder.encode(t))
                except (KeyboardInterrupt, SystemExit):
                    raise
                except BaseException:  # the library's own failures are no Exception
                    return None

            return pd.Series([one(t) for t in texts], dtype="Int64")

        exact = counted(F.col(text_col))
    return (
        docs.withColumn("_exact", exact)
        .withColumn("token_count", F.coalesce("_exact", text.approx_tokens(F.col(text_col))))
        .withColumn("counted_by", F.when(F.col("_exact").isNotNull(), "vocabulary").when(F.col("token_count").isNotNull(), "length"))
        .drop("_exact")
    )


def file_for_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Attach the text of the file each request points at; '' when there is none."""
    f = files.select("repo", "file_path", F.col("text").alias("_text"))
    return (
        requests.join(f, ["repo", "file_path"], "left")
        .withColumn("file_content", F.coalesce("_text", F.lit("")))
        .drop("_text")
    )
