"""One query per operator, over whole tables, with check SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.llm import chat, collocations, decontaminate, jaccard_join, line_dedup, mixing, packing, quality_rules, spelling, substring_dedup, token_counts, token_shards, url_rules

#: Rules of the url query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"), window=3)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), ratio=1.5, most=2)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shared=None)


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.windows(turns, public_tokenizers.path("byte_bpe_50k.json")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), min_count=10, longest=3, keep=2000, absorb=50)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), ratio=10, min_chars=7, min_count=2, noise=31)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_token_shards, op4_substring_dedup, op5_quality_rules, op6_source_mix, op7_decontaminate, op8_chat_windows, op9_jaccard_join, op10_url_rules, op11_collocations, op12_packing, op13_spelling_variants)}

_LINES = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL AND text <> ''),
win AS (SELECT doc_id, pos, x[pos] || chr(10) || x[pos + 1] || chr(10) || x[pos + 2] AS k
        FROM (SELECT doc_id, x, unnest(range(1, len(x) - 1)) AS pos FROM l)),
real AS (SELECT * FROM win WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]')),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM real),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE r > 1),
line AS (SELECT doc_id, x[pos] AS s, pos FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS pos FROM l)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
                coalesce(string_agg(s, chr(10) ORDER BY line.pos) FILTER (WHERE g.pos IS NULL), '') AS t
         FROM line LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""

_PASSAGES = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, pos, array_to_string(x[pos:pos + 34], ' ') AS k
        FROM (SELECT doc_id, x, unnest(range(1, len(x) - 33)) AS pos FROM w)),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY md5(k)) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM twice),
word AS (SELECT doc_id, x[pos] AS s, pos FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS pos FROM w)),
kept AS (SELECT doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
                coalesce(string_agg(s, ' ' ORDER BY word.pos) FILTER (WHERE g.pos IS NULL), '') AS t
         FROM word LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_URLS = f"""
WITH r(rh, rp, rv) AS (VALUES {_RULE_ROWS}),
a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN url[position('://' IN url) + 3:] ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest[length(h) + 1:], '^[^?#]*') AS path FROM b),
m AS (SELECT page_id, host, path, rh || rp AS rule, rv,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, rv DESC) AS k
      FROM c LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1"""

_COLLOCATIONS = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
           FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS x FROM p),
g AS (SELECT lang, unnest(x) AS phrase, 1 AS k FROM w
      UNION ALL SELECT lang, unnest([x[i] || ' ' || x[i + 1] for i in range(1, len(x))]), 2 FROM w
      UNION ALL SELECT lang, unnest([x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] for i in range(1, len(x) - 1)]), 3 FROM w),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(x[1:j], ' ') AS le, array_to_string(x[j + 1:], ' ') AS ri
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, j, fl.a AS l, fr.a AS r,
             (1000000::HUGEINT * cuts.a * cuts.a) // (fl.a::HUGEINT * fr.a) AS score
      FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = le JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = ri),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s) WHERE o = 1),
inner_two AS (SELECT lang, phrase, max(a) AS longer FROM (
                SELECT lang, x[1] || ' ' || x[2] AS phrase, a FROM c WHERE k = 3
                UNION ALL SELECT lang, x[2] || ' ' || x[3], a FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT low.* FROM low LEFT JOIN inner_two i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES = {"op2_line_dedup": _LINES, "op4_substring_dedup": _PASSAGES, "op10_url_rules": _URLS, "op11_collocations": _COLLOCATIONS}
