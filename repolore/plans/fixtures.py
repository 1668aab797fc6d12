"""Inputs derived from the given tables, for the registered queries.

The operators need files, chunks, requests, wikis and responses; the tables hold documents, conversations, pages,
vectors and events. Each derivation is one SQL text used by Spark here and, as a CTE, by the checking engine.
``MKLIST(`` stands for the list constructor, the one spelling that differs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.operators import corpus

N_VECTORS = "(SELECT count(*) FROM embeddings)"
BASE = ["documents", "embeddings", "conversations", "pages", "events", "labels", "benchmark", "orders", "lineitem"]


@dataclass(frozen=True)
class Fixture:
    sql: str
    deps: tuple[str, ...] = ()
    duck: str | None = None

    def spark_sql(self) -> str:
        return self.sql.replace("MKLIST(", "array(")

    def duck_sql(self) -> str:
        return (self.duck or self.sql).replace("MKLIST(", "list_value(")


FX: dict[str, Fixture] = {}


def _fx(name: str, sql: str, deps: tuple[str, ...] = (), duck: str | None = None) -> None:
    FX[name] = Fixture(sql, deps, duck)


_fx(
    "fx_files",
    """
SELECT doc_id, source AS repo,
 concat(CASE doc_id%8 WHEN 0 THEN 'src' WHEN 1 THEN 'src/core' WHEN 2 THEN 'tests' WHEN 3 THEN 'docs'
        WHEN 4 THEN 'node_modules/x' WHEN 5 THEN 'app/ui' WHEN 6 THEN '.github/flows' ELSE 'build' END, '/',
  CASE WHEN doc_id%41=0 THEN concat('p', cast(doc_id AS varchar(20)), '/README.md')
    WHEN doc_id%43=0 THEN concat('p', cast(doc_id AS varchar(20)), '/yarn.lock')
  ELSE concat(CASE WHEN doc_id%13=0 THEN 'test_' WHEN doc_id%17=0 THEN '_' WHEN doc_id%19=0 THEN '.' ELSE '' END,
   'doc_', cast(doc_id AS varchar(20)),
   CASE doc_id%9 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.js' WHEN 3 THEN '.json' WHEN 4 THEN '.ts'
    WHEN 5 THEN '.txt' WHEN 6 THEN '.go' WHEN 7 THEN '.yml' ELSE '.min.js' END) END) AS file_path,
 text FROM documents""",
)
_fx(
    "fx_chunks",
    """
SELECT doc_id*8388608+ord AS chunk_id, doc_id, repo, file_path, ord, array_join(slice(w, ord*250+1, 350),' ') AS text
FROM (SELECT doc_id, repo, file_path, split(text,' ') w FROM fx_files)
LATERAL VIEW explode(sequence(0, cast(greatest(ceil((size(w)-350)/250.0),0) AS int))) AS ord""",
    ("fx_files",),
    duck="""
SELECT doc_id*8388608+ord AS chunk_id, doc_id, repo, file_path, ord,
 array_to_string(w[ord*250+1 : ord*250+350],' ') AS text
FROM (SELECT doc_id, repo, file_path, string_split(text,' ') w FROM fx_files),
     unnest(range(0, cast(greatest(ceil((len(w)-350)/250.0),0) AS int)+1)) u(ord)""",
)
_fx(
    "fx_chunk_vectors",
    """
SELECT c.chunk_id, c.doc_id, c.repo, c.file_path, c.ord, c.text, e.embedding AS vector
FROM fx_chunks c JOIN embeddings e ON e.vec_id = (c.doc_id*7+c.ord) % (SELECT count(*) FROM embeddings)""",
    ("fx_chunks",),
)
_fx(
    "fx_queries",
    """
SELECT q.conv_id AS query_id, f.repo, e.embedding AS vector
FROM (SELECT DISTINCT conv_id FROM conversations) q
JOIN fx_files f ON f.doc_id = q.conv_id
JOIN embeddings e ON e.vec_id = (q.conv_id*13+5) % (SELECT count(*) FROM embeddings)""",
    ("fx_files",),
)
_fx(
    "fx_dirty_vectors",
    """
SELECT concat('r', cast(label AS varchar(9))) AS repo, vec_id AS chunk_id,
 CASE WHEN vec_id%23=0 THEN NULL WHEN vec_id%29=0 THEN slice(embedding, 1, 0)
      WHEN vec_id%31=0 THEN slice(embedding, 1, 32) ELSE embedding END AS vector
FROM embeddings""",
    duck="""
SELECT concat('r', cast(label AS varchar(9))) AS repo, vec_id AS chunk_id,
 CASE WHEN vec_id%23=0 THEN NULL WHEN vec_id%29=0 THEN embedding[1:0]
      WHEN vec_id%31=0 THEN embedding[1:32] ELSE embedding END AS vector
FROM embeddings""",
)
_fx(
    "fx_messages",
    """
SELECT conv_id, turn, role,
 CASE WHEN conv_id%10=0 AND turn=mx THEN '[DEEP RESEARCH] Continue the research'
      WHEN conv_id%5=0 AND turn=0 THEN concat('[DEEP RESEARCH] ', text) ELSE text END AS content
FROM conversations JOIN (SELECT conv_id AS cid, max(turn) AS mx FROM conversations GROUP BY conv_id) m ON conv_id = cid""",
)
_fx(
    "fx_requests",
    """
SELECT q.conv_id, f.repo,
 concat('https://', CASE q.conv_id%4 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' WHEN 2 THEN 'bitbucket.org'
   ELSE 'git.example.org' END, '/team', cast(q.conv_id%7 AS varchar(9)), '/', f.repo,
   CASE WHEN q.conv_id%3=0 THEN '.git' ELSE '' END, CASE WHEN q.conv_id%11=0 THEN '/' ELSE '' END) AS repo_url,
 CASE q.conv_id%4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE 'web' END AS type,
 CASE q.conv_id%5 WHEN 0 THEN 'google' WHEN 1 THEN 'openai' WHEN 2 THEN 'ollama' WHEN 3 THEN 'openrouter'
   ELSE 'unlisted' END AS provider,
 CASE q.conv_id%3 WHEN 0 THEN NULL WHEN 1 THEN 'custom-model' ELSE 'model-b' END AS model,
 CASE q.conv_id%12 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' WHEN 3 THEN 'zh-tw' WHEN 4 THEN 'es'
   WHEN 5 THEN 'kr' WHEN 6 THEN 'vi' WHEN 7 THEN 'pt-br' WHEN 8 THEN 'fr' WHEN 9 THEN 'ru' WHEN 10 THEN 'de'
   ELSE NULL END AS language,
 CASE WHEN q.conv_id%3=0 THEN f.file_path WHEN q.conv_id%3=1 THEN 'no/such/file.py' ELSE NULL END AS file_path,
 concat('./extra', cast(q.conv_id%4 AS varchar(9)), '/', chr(10), '  ', chr(10), 'my%20dir', chr(10), 'a+b', chr(10),
   'bad%zz') AS excluded_dirs,
 concat('f', cast(q.conv_id%6 AS varchar(9)), '.lock', chr(10), 'yarn.lock') AS excluded_files
FROM (SELECT DISTINCT conv_id FROM conversations) q JOIN fx_files f ON f.doc_id = q.conv_id""",
    ("fx_files",),
)
_fx(
    "fx_models",
    """
SELECT provider, model, concat('{"temperature":', cast(n%10 AS varchar(9)), '}') AS params, rn = 1 AS is_default
FROM (SELECT provider, model, count(*) AS n, row_number() OVER (PARTITION BY provider ORDER BY model) AS rn
 FROM (SELECT CASE conv_id%4 WHEN 0 THEN 'google' WHEN 1 THEN 'openai' WHEN 2 THEN 'ollama' ELSE 'openrouter' END
   AS provider, CASE turn%3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model
  FROM conversations) m GROUP BY provider, model) r""",
)
_fx(
    "fx_wiki_pages",
    """
SELECT concat('w', cast(cast(floor(page_id/13.0) AS bigint) AS varchar(20))) AS wiki_id, page_id AS pos,
 concat('page-', cast(page_id AS varchar(20))) AS id,
 concat('Topic ', cast(page_id AS varchar(20)), ' ', CASE page_id%6 WHEN 0 THEN 'Overview' WHEN 1 THEN 'API server'
   WHEN 2 THEN 'Data flow' WHEN 3 THEN 'Setup' WHEN 4 THEN 'Widget' ELSE 'Misc' END) AS title,
 CASE page_id%3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS importance,
 MKLIST(concat('page-', cast(page_id+1 AS varchar(20))), 'page-999999999',
   concat('page-', cast(page_id+5 AS varchar(20)))) AS related,
 MKLIST(f.file_path, concat('lib/part', cast(page_id%5 AS varchar(20)), '.go')) AS file_paths,
 CASE WHEN page_id%19=0 THEN '' ELSE concat('# Topic ', cast(page_id AS varchar(20)), chr(10), chr(10), f.text) END
   AS content
FROM pages p JOIN fx_files f ON f.doc_id = p.page_id""",
    ("fx_files",),
)
_fx("fx_wikis", "SELECT DISTINCT wiki_id, cast(substr(wiki_id, 2) AS bigint) AS n FROM fx_wiki_pages", ("fx_wiki_pages",))
_fx(
    "fx_generated",
    "SELECT p.wiki_id, p.id, p.content FROM fx_wiki_pages p JOIN labels l ON l.doc_id = p.pos",
    ("fx_wiki_pages",),
)
_fx(
    "fx_in_flight",
    "SELECT p.wiki_id, p.id, p.pos AS seq FROM fx_wiki_pages p JOIN labels l ON l.doc_id = p.pos WHERE l.quality = 0",
    ("fx_wiki_pages",),
)
_SECTIONS = """
SELECT wiki_id, concat('s', cast(k AS varchar(9))) AS section_id, cast(k AS bigint) AS pos,
 concat('Section ', cast(k AS varchar(9))) AS title,
 CASE WHEN k <= 3 THEN MKLIST(concat('s', cast(2*k AS varchar(9))), concat('s', cast(2*k+1 AS varchar(9))))
      WHEN k = 7 AND n%4 = 3 THEN MKLIST('s3', 's99') ELSE EMPTYLIST END AS child_ids,
 MKLIST(concat('page-', cast(13*n+k AS varchar(20))), 'page-999999999', concat('page-', cast(13*n+k+3 AS varchar(20))))
   AS page_ids
FROM """
_fx(
    "fx_sections",
    _SECTIONS.replace("EMPTYLIST", "cast(array() AS array<string>)")
    + "(SELECT wiki_id, n, explode(sequence(1, 8)) AS k FROM fx_wikis)",
    ("fx_wikis",),
    duck=_SECTIONS.replace("EMPTYLIST", "cast([] AS varchar[])") + "fx_wikis, unnest(range(1, 9)) u(k)",
)
_fx(
    "fx_cache_wikis",
    """
SELECT wiki_id, n, CASE n%3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS repo_type,
 concat('own', cast(n%4 AS varchar(9))) AS owner, concat('repo_', wiki_id) AS repo,
 CASE n%4 WHEN 0 THEN 'en' WHEN 1 THEN 'ja' WHEN 2 THEN 'pt-br' ELSE 'xx' END AS language,
 concat('Wiki ', wiki_id) AS title, 'google' AS provider, 'model-a' AS model,
 concat('https://github.com/own/', wiki_id) AS repo_url
FROM fx_wikis""",
    ("fx_wikis",),
)
_fx(
    "fx_responses",
    """
SELECT conv_id, cast(floor((turn+1)/2.0) AS bigint) AS iteration, turn AS seq,
 concat(CASE (conv_id+turn)%7 WHEN 0 THEN concat('## Research Plan', chr(10), chr(10))
   WHEN 1 THEN concat('## Research Update ', cast(cast(floor((turn+1)/2.0) AS bigint) AS varchar(9)), chr(10))
   WHEN 2 THEN concat('## Final Conclusion', chr(10)) WHEN 3 THEN concat('## Summary', chr(10))
   WHEN 4 THEN concat('## Summary', chr(10), 'Next Steps', chr(10)) WHEN 5 THEN 'This Dockerfile. '
   ELSE '' END, text) AS content
FROM conversations WHERE role = 'assistant'""",
)
_fx(
    "fx_sse",
    """
SELECT cast(floor(event_id/200.0) AS bigint) AS response_id, event_id AS seq,
 CASE event_id%10 WHEN 0 THEN ': ping' WHEN 1 THEN '' WHEN 2 THEN 'data: {bad'
  WHEN 3 THEN concat('data: {"choices":[{"text":"t', cast(event_id AS varchar(12)), '"}]}')
  ELSE CASE WHEN event_id%97=0 THEN 'data: [DONE]'
   ELSE concat('data: {"choices":[{"delta":{"content":"', event_type, ' "}}]}') END END AS line
FROM events""",
)
_fx(
    "fx_deltas",
    """
SELECT cast(floor(event_id/200.0) AS bigint) AS response_id, event_id AS seq,
 CASE event_id%6 WHEN 0 THEN NULL WHEN 1 THEN 'model=x' WHEN 2 THEN concat('<think>', event_type, '</think>')
   WHEN 3 THEN 'created_at=now' ELSE concat(event_type, ' ') END AS delta,
 CASE WHEN event_id%5=0 THEN concat('id-', cast(event_id AS varchar(12))) ELSE '' END AS id,
 CASE WHEN event_id%7=0 THEN concat('m', cast(event_id%3 AS varchar(12))) ELSE NULL END AS model,
 CASE WHEN event_id%4=0 THEN event_id ELSE NULL END AS created,
 CASE WHEN event_id%11=0 THEN event_id+1 ELSE NULL END AS total_tokens
FROM events""",
)
_fx(
    "fx_completions",
    """
SELECT event_id AS id, CASE event_id%6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'amazon' WHEN 2 THEN 'cohere' WHEN 3 THEN 'ai21'
   WHEN 4 THEN 'openai' ELSE 'other' END AS provider, concat('m', cast(user_id%3 AS varchar(9))) AS model,
 event_type AS want, event_id%3+1 AS n_choices,
 CASE WHEN event_id%11=0 THEN NULL ELSE event_id%100 END AS ptok,
 concat('{', CASE event_id%6
   WHEN 0 THEN concat('"content":[{"text":"', event_type, '"}]')
   WHEN 1 THEN concat('"results":[{"outputText":"', event_type, '"}]')
   WHEN 2 THEN concat('"generations":[{"text":"', event_type, '"}]')
   WHEN 3 THEN concat('"completions":[{"data":{"text":"', event_type, '"}}]')
   WHEN 4 THEN concat('"choices":[{"message":{"content":"', event_type, '"},"logprobs":{"content":[{"token":"a","logprob":-0.5},{"token":"',
      event_type, '","logprob":-1.25}]}}', CASE WHEN event_id%3>0 THEN ',{"message":{"content":"second"}}' ELSE '' END,
      CASE WHEN event_id%3>1 THEN ',{"message":{"content":"third"}}' ELSE '' END, ']')
   ELSE concat('"output":"', event_type, '"') END,
  CASE WHEN event_id%11=0 THEN '' ELSE concat(',"usage":{"prompt_tokens":', cast(event_id%100 AS varchar(9)),
    ',"completion_tokens":', cast(event_id%10 AS varchar(9)), ',"total_tokens":', cast(event_id%100+event_id%10 AS varchar(9)), '}') END,
  '}') AS raw
FROM events""",
)
_fx(
    "fx_cache_names",
    """
SELECT doc_id, CASE WHEN doc_id%17=0 THEN concat('wiki_cache_', lang, '_', source, '.json')
  WHEN doc_id%19=0 THEN concat('other_', source, '.json')
  ELSE concat('wiki_cache_', CASE doc_id%3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END, '_Team',
   cast(doc_id%7 AS varchar(9)), '_', source, CASE WHEN doc_id%5=0 THEN '_x_y' ELSE '' END, '_', lang, '.json') END AS name,
 1700000000000 + (doc_id*7919)%1000003 AS mtime_ms
FROM documents""",
)
_fx(
    "fx_references",
    """
SELECT doc_id, CASE doc_id%11 WHEN 0 THEN concat('https://github.com/Team', cast(doc_id%7 AS varchar(9)), '/', source, '.git')
  WHEN 1 THEN concat('gitlab.com/group/sub', cast(doc_id%5 AS varchar(9)), '/', source)
  WHEN 2 THEN concat('  https://bitbucket.org/team/', source, '/ ')
  WHEN 3 THEN concat('/home/user/', source, '/proj', cast(doc_id AS varchar(20)))
  WHEN 4 THEN concat('C:', chr(92), 'work', chr(92), source) WHEN 5 THEN source
  WHEN 6 THEN concat('http://git.example.org:8080/a/', source, '?tab=1#top')
  WHEN 7 THEN concat('https://gitlab.example.com:443/x/', source, '.git/') WHEN 8 THEN '/'
  WHEN 9 THEN concat('HTTPS://GitHub.com/T/', source) ELSE concat('https://', source) END AS ref,
 CASE doc_id%4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' ELSE 'local' END AS type
FROM documents""",
)
_fx(
    "fx_plans",
    """
SELECT doc_id, source AS repo,
 CASE doc_id%5 WHEN 0 THEN concat('1. Intro: about ', source, chr(10), '2. Design: parts: more', chr(10), '3. End')
  WHEN 1 THEN concat('1) Intro: about ', lang, chr(10), '2) Design') WHEN 2 THEN concat('Slide 1: Intro', chr(10), 'slide 2 Design: x')
  WHEN 3 THEN concat('Big picture', chr(10), 'Please wait', chr(10), 'abc', chr(10), 'Parts: the parts') ELSE '' END AS plan,
 text
FROM documents""",
)
_fx(
    "fx_workshops",
    """
SELECT doc_id, concat('# Workshop ', source, chr(10), chr(10), substr(text, 1, cast(floor(length(text)/2.0) AS int)), chr(10), '## Exercise 1: Start, now!', chr(10), 'Do it.', chr(10),
 CASE WHEN doc_id%2=0 THEN concat('## Exercise 2: More_x', chr(10), '```python', chr(10), 'x = 1', chr(10), '```', chr(10)) ELSE '' END,
 CASE WHEN doc_id%3=0 THEN concat('## Exercise 3: Deep', chr(10), '```mermaid', chr(10), 'a-->b', chr(10), '```', chr(10),
   '## Exercise 4: Last', chr(10)) ELSE '' END,
 '## Final Project', chr(10), 'Build.', chr(10), substr(text, cast(floor(length(text)/2.0) AS int)+1)) AS content
FROM documents""",
)


class Tables:
    """Given tables and derived inputs by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in FX:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        base = [f"{b} AS (SELECT * FROM parquet.`{self.sf_dir}/{b}.parquet`)" for b in _base_of(name)]
        ctes = base + [f"{n} AS ({FX[n].spark_sql()})" for n in _closure((name,))]
        text = f"WITH {', '.join(ctes)} SELECT * FROM {name}"
        if N_VECTORS in text:  # a literal: join keys with scalar subqueries are not always ready in time in Spark 4.1
            text = text.replace(N_VECTORS, str(self("embeddings").count()))
        return self.spark.sql(text)

    def stream(self, name: str) -> DataFrame:
        """The same rows as a stream: a base table, or a derived input over one base table."""
        base = name if name not in FX else _base_of(name)[0]
        path = f"{self.sf_dir}/{base}.parquet"
        pattern = path.replace(".parquet", ".parque[t]")  # a stream takes a single file only as a pattern
        schema = self.spark.read.parquet(path).schema
        rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(pattern)
        if name not in FX:
            return rows
        view = f"stream_{name}_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        return self.spark.sql(FX[name].spark_sql().replace(f"FROM {base}", f"FROM {view}"))

    def chunks(self) -> DataFrame:
        """Chunks of all files, by the operator itself."""
        return corpus.chunk_words(self("fx_files")).withColumn("chunk_id", corpus.chunk_id())


def _closure(names: tuple[str, ...]) -> list[str]:
    """Names with everything they need, needed ones first."""
    out: list[str] = []
    for n in names:
        for x in [*_closure(FX[n].deps), n]:
            if x not in out:
                out.append(x)
    return out


def _base_of(name: str) -> list[str]:
    text = " ".join(FX[n].sql for n in _closure((name,)))
    return [b for b in BASE if f" {b} " in f"{text} ".replace("\n", " ").replace(")", " ")]


def oracle(body: str, fx: tuple[str, ...] = (), ctes: str = "") -> str:
    """Check SQL: the derived inputs as CTEs, further CTEs, then ``body``."""
    parts = [f"{n} AS ({FX[n].duck_sql()})" for n in _closure(fx)]
    if ctes:
        parts.append(ctes)
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body
