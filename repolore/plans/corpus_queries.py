"""Sources, file filters, typing and chunking over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import paths, text
from repolore.operators import corpus
from repolore.operators.ordered import join_text, whole_texts
from repolore.plans.registry import query, sql_in, sql_list

_EXCL_DIRS = (
    f"list_transform({sql_list(C.EXCLUDED_DIRS)}, lambda d: regexp_replace(d, '^[./]+|[./]+$', '', 'g'))"
)
_NAME = "string_split(file_path, '/')[-1]"
_EXT = f"regexp_extract({_NAME}, '\\.([^.]+)$', 1)"
_LISTED = f"""NOT (len(list_filter(string_split(file_path, '/')[1:-2],
  lambda d: starts_with(d, '.') OR d IN {sql_in(C.LISTING_PRUNED_DIRS)})) > 0
  OR starts_with({_NAME}, '.') OR {_NAME} IN {sql_in(C.LISTING_SKIPPED_FILES)})"""
_SPACE_RE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


@query("flt1_exclude_paths", f"""SELECT doc_id, repo, file_path FROM fx_files
  WHERE NOT list_has_any(string_split(file_path, '/'), {_EXCL_DIRS})
    AND NOT list_contains({sql_list(C.EXCLUDED_FILES)}, {_NAME})""", ("fx_files",))
def _(t):
    return corpus.exclude_paths(t("fx_files")).select("doc_id", "repo", "file_path")


_INCL_DIRS, _INCL_FILES = ["./src/", "lib"], [".md", "yarn.lock"]


@query("flt2_include_paths", f"""SELECT doc_id, repo, file_path FROM fx_files
  WHERE list_has_any(string_split(file_path, '/'), ['src', 'lib'])
     OR ends_with({_NAME}, '.md') OR ends_with({_NAME}, 'yarn.lock')""", ("fx_files",))
def _(t):
    return corpus.include_paths(t("fx_files"), paths.strings(_INCL_DIRS), paths.strings(_INCL_FILES)).select(
        "doc_id", "repo", "file_path"
    )


@query("flt3_clean_dirs", """SELECT doc_id, regexp_replace(concat('./', string_split(file_path, '/')[1], '/.'),
  '^[./]+|[./]+$', '', 'g') AS dir FROM fx_files""", ("fx_files",))
def _(t):
    first = F.concat(F.lit("./"), F.get(F.split("file_path", "/"), F.lit(0)), F.lit("/."))
    return t("fx_files").select("doc_id", paths.clean_dir(first).alias("dir"))


@query("flt4_union_filters", f"""SELECT conv_id, len(u) AS n, array_to_string(list_sort(u), '|') AS dirs
  FROM (SELECT conv_id, list_distinct(list_concat({sql_list(C.EXCLUDED_DIRS)},
    list_transform(list_filter(string_split(excluded_dirs, chr(10)), lambda x: trim(x) <> ''),
    lambda x: CASE WHEN x = 'my%20dir' THEN 'my dir' ELSE x END))) AS u FROM fx_requests)""", ("fx_requests",))
def _(t):
    u = paths.union_lists(corpus.default_excluded_dirs(), paths.decode_list(F.col("excluded_dirs")))
    return t("fx_requests").select("conv_id", u.alias("u")).select(
        "conv_id", F.size("u").cast("bigint").alias("n"), F.array_join(F.array_sort("u"), "|").alias("dirs")
    )


@query("flt5_token_cap", f"""SELECT doc_id, file_path, length(text)//4 AS token_count FROM fx_files
  WHERE length(text)//4 <= CASE WHEN {_EXT} IN {sql_in(C.CODE_EXTENSIONS)} THEN 81920 ELSE 8192 END""", ("fx_files",))
def _(t):
    return corpus.cap_tokens(t("fx_files")).select("doc_id", "file_path", "token_count")


@query("flt6_decode_lists", """SELECT conv_id,
  concat(string_split(excluded_dirs, chr(10))[1], '|my dir|a+b|bad%zz') AS dirs,
  replace(excluded_files, chr(10), '|') AS files FROM fx_requests""", ("fx_requests",))
def _(t):
    return t("fx_requests").select(
        "conv_id",
        F.array_join(paths.decode_list(F.col("excluded_dirs")), "|").alias("dirs"),
        F.array_join(paths.decode_list(F.col("excluded_files")), "|").alias("files"),
    )


_HIDDEN = "regexp_matches(file_path, '(^|/)\\.')"


@query("prj1_file_type", f"""SELECT doc_id, {_EXT} AS type, {_EXT} IN {sql_in(C.CODE_EXTENSIONS)} AS is_code FROM fx_files
  WHERE {_EXT} IN {sql_in(C.CODE_EXTENSIONS + C.DOC_EXTENSIONS)} AND NOT {_HIDDEN}""", ("fx_files",))
def _(t):
    return corpus.type_files(t("fx_files")).select("doc_id", "type", "is_code")


@query("prj2_implementation_flag", f"""SELECT doc_id, ({_EXT} IN {sql_in(C.CODE_EXTENSIONS)}
   AND NOT starts_with(file_path, 'test_') AND NOT starts_with(file_path, 'app_')
   AND NOT contains(lower(file_path), 'test')) AS is_implementation FROM fx_files""", ("fx_files",))
def _(t):
    return t("fx_files").select("doc_id", paths.is_implementation(F.col("file_path")).alias("is_implementation"))


@query("chk1_word_chunks", "SELECT chunk_id, repo, file_path, cast(ord AS integer) AS ord, text FROM fx_chunks", ("fx_chunks",))
def _(t):
    return t.chunks().select("chunk_id", "repo", "file_path", "ord", "text")


@query("chk2_token_count", "SELECT doc_id, length(text)//4 AS token_count FROM documents")
def _(t):
    return t("documents").select("doc_id", text.approx_tokens(F.col("text")).alias("token_count"))


def _vocabulary() -> tuple[str | None, str]:
    """Rank file and pattern of the public vocabulary, where it is installed."""
    try:
        import public_tokenizers as P
    except ImportError:
        return None, ""
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@query("chk2_vocabulary_count")
def _(t):
    return corpus.count_tokens(t("documents").select("doc_id", "text"), *_vocabulary()).drop("text")


@query("chk3_token_estimate", f"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACE_RE}'),
   lambda x: x <> '')) AS tokens FROM documents""")
def _(t):
    return t("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("src2_tree_listing", f"SELECT repo, file_path FROM fx_files WHERE {_LISTED}", ("fx_files",))
def _(t):
    return corpus.list_tree(t("fx_files"))


@query("src3_readme_pick", f"""SELECT repo, file_path, text AS readme FROM (SELECT *, row_number() OVER (PARTITION BY repo
   ORDER BY len(string_split(file_path, '/')), file_path, text) AS rn FROM fx_files
   WHERE lower({_NAME}) = 'readme.md' AND text <> '' AND {_LISTED}) WHERE rn = 1""", ("fx_files",))
def _(t):
    return corpus.pick_readme(t("fx_files"))


def _dumps(t):
    """Listing responses as saved by a provider: pages of entries with directory rows in between."""
    entry = F.concat(
        F.lit('{"type":"'), F.when(F.col("doc_id") % 2 == 0, "blob").otherwise("commit_file"), F.lit('","path":"'),
        F.col("file_path"), F.lit('"},{"type":"tree","path":"'), F.col("repo"), F.lit('"}'),
    )
    parts = t("fx_files").select("repo", F.floor(F.col("doc_id") / 100).alias("page"), "doc_id", entry.alias("e"))
    joined = join_text(parts, ["repo", "page"], ["doc_id"], "e", sep=",", out="body")
    return joined.select("repo", "page", F.concat(F.lit("["), F.col("body"), F.lit("]")).alias("json"))


@query("src4_tree_dump", """SELECT repo, 0::BIGINT AS block, string_agg(file_path, chr(10) ORDER BY doc_id) AS file_tree FROM fx_files
  GROUP BY repo""", ("fx_files",))
def _(t):
    rows = corpus.explode_tree_dump(_dumps(t))
    return whole_texts(rows, ["repo"], ["page", "pos"], "path", sep="\n", out="file_tree")


@query("src5_contents_decode", """SELECT doc_id, CASE WHEN doc_id%10 IN (1, 2, 3) THEN NULL ELSE text END AS text,
  CASE doc_id%10 WHEN 1 THEN 'API error: Not Found' WHEN 2 THEN 'unexpected encoding: none'
   WHEN 3 THEN 'API error: gone' END AS error FROM documents""")
def _(t):
    d = t("documents")
    k = F.col("doc_id") % 10
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r\n", "\n")
    body = (
        F.when(k == 1, '{"message":"Not Found","documentation_url":"x"}')
        .when(k == 2, F.to_json(F.struct(F.lit("").alias("content"), F.lit("none").alias("encoding"))))
        .when(k == 3, '{"message":"gone"}')
        .when(k == 4, F.col("text"))
        .otherwise(F.to_json(F.struct(b64.alias("content"), F.lit("base64").alias("encoding"))))
    )
    provider = F.when(k == 3, "gitlab").when(k == 4, "bitbucket").otherwise("github")
    return corpus.decode_contents(d.select("doc_id", provider.alias("provider"), body.alias("body"))).select(
        "doc_id", "text", "error"
    )
