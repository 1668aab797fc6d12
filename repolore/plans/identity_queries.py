"""Repository references, keys, links and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions import urls
from repolore.plans.registry import query, sql_in

_WEB = r"^(https?)://(?:[^/?#@]*@)?([^/:?#\s]+)(:[0-9]*)?(/[^?#]*)?([?#].*)?$"
_WEB_CTES = rf"""norm AS (SELECT *, CASE WHEN starts_with(ref, 'http') THEN ref ELSE concat('https://', ref) END AS u
   FROM fx_references),
 web AS (SELECT *, regexp_matches(u, '{_WEB}') AS ok, regexp_extract(u, '{_WEB}', 1) AS proto,
   lower(regexp_extract(u, '{_WEB}', 2)) AS host, regexp_extract(u, '{_WEB}', 3) AS port,
   regexp_extract(u, '{_WEB}', 4) AS path FROM norm),
 dom AS (SELECT *, CASE WHEN ok THEN concat(proto, '://', host, CASE WHEN port = ':'
   OR port = CASE WHEN proto = 'https' THEN ':443' ELSE ':80' END THEN '' ELSE port END) END AS domain,
   CASE WHEN ok THEN regexp_replace(path, '^/|/$', '', 'g') END AS url_path FROM web)"""


@query("prj3_repo_key", f"""SELECT doc_id, CASE WHEN type IN {sql_in(C.HOSTED_TYPES)} AND len(p) >= 5
   THEN concat(p[-2], '_', replace(p[-1], '.git', '')) ELSE replace(p[-1], '.git', '') END AS repo_key
  FROM (SELECT *, string_split(regexp_replace(ref, '/+$', ''), '/') AS p FROM fx_references)""", ("fx_references",))
def _(t):
    return t("fx_references").select("doc_id", urls.repo_key(F.col("ref"), F.col("type")).alias("repo_key"))


_TRIMMED = _WEB_CTES.replace("fx_references)", "(SELECT doc_id, trim(ref) AS ref FROM fx_references))")


@query("prj4_parse_reference", rf"""
  SELECT doc_id, CASE WHEN keep THEN owner END AS owner, CASE WHEN keep THEN regexp_replace(repo, '\.git$', '') END AS repo,
   CASE WHEN keep THEN kind END AS type, CASE WHEN keep AND kind <> 'local' THEN full_path END AS full_path,
   CASE WHEN keep AND kind = 'local' THEN ref END AS local_path
  FROM (SELECT *, (kind = 'local' OR url_like) AND coalesce(owner, '') <> '' AND coalesce(repo, '') <> '' AS keep FROM (
   SELECT *, CASE WHEN kind = 'local' THEN 'local' WHEN len(parts) >= 2 THEN parts[-2] END AS owner,
    CASE WHEN win THEN coalesce(nullif(string_split(ref, chr(92))[-1], ''), 'local-repo')
     WHEN kind = 'local' THEN coalesce(list_filter(string_split(ref, '/'), lambda x: x <> '')[-1], 'local-repo')
     WHEN len(parts) >= 2 THEN parts[-1] END AS repo
   FROM (SELECT *, string_split(full_path, '/') AS parts, CASE WHEN win OR starts_with(ref, '/') THEN 'local'
     WHEN contains(coalesce(domain, ''), 'github.com') THEN 'github' WHEN contains(coalesce(domain, ''), 'gitlab.') THEN 'gitlab'
     WHEN contains(coalesce(domain, ''), 'bitbucket.') THEN 'bitbucket' ELSE 'web' END AS kind
   FROM (SELECT *, regexp_matches(ref, '{C.WINDOWS_PATH}') AS win, regexp_matches(ref, '{C.REPO_URL}') AS url_like,
     regexp_replace(url_path, '\.git$', '') AS full_path FROM dom))))""", ("fx_references",), ctes=_TRIMMED)
def _(t):
    r = t("fx_references").select("doc_id", urls.parse_reference(F.col("ref")).alias("r"))
    return r.select("doc_id", "r.owner", "r.repo", "r.type", "r.full_path", "r.local_path")


@query("prj5_domain_path", "SELECT doc_id, domain, url_path FROM dom", ("fx_references",), ctes=_WEB_CTES)
def _(t):
    ref = F.col("ref")
    return t("fx_references").select("doc_id", urls.domain(ref).alias("domain"), urls.path(ref).alias("url_path"))


@query("prj6_canonical_url", """SELECT doc_id, CASE WHEN type = 'local' AND doc_id%3 > 0 THEN concat('/srv/', ref)
   WHEN doc_id%5 > 0 THEN ref WHEN doc_id%2 = 0 THEN concat('http://example/own/', type) ELSE '' END AS url
  FROM fx_references""", ("fx_references",))
def _(t):
    d = F.col("doc_id")
    local = F.when(d % 3 > 0, F.concat(F.lit("/srv/"), F.col("ref")))
    url = F.when(d % 5 > 0, F.col("ref"))
    owner = F.when(d % 2 == 0, "own")
    return t("fx_references").select("doc_id", urls.canonical_url(F.col("type"), local, url, owner, F.col("type")).alias("url"))


@query("prj7_file_link", """SELECT p.wiki_id, p.id, i AS pos, CASE WHEN r.type IS NULL OR r.type = 'web' THEN p.file_paths[i]
   ELSE concat(r.repo_url, CASE r.type WHEN 'github' THEN '/blob/' WHEN 'gitlab' THEN '/-/blob/' ELSE '/src/' END, 'main/',
    p.file_paths[i]) END AS link
  FROM fx_wiki_pages p LEFT JOIN fx_requests r ON r.conv_id = p.pos, unnest([1, 2]) u(i)""", ("fx_wiki_pages", "fx_requests"))
def _(t):
    r = t("fx_requests").select(F.col("conv_id").alias("pos"), "type", "repo_url")
    p = t("fx_wiki_pages").join(r, "pos", "left").select("wiki_id", "id", "type", "repo_url", F.posexplode("file_paths").alias("i", "p"))
    return p.select(
        "wiki_id", "id", (F.col("i") + 1).alias("pos"),
        urls.file_link(F.coalesce("type", F.lit("web")), F.col("repo_url"), F.lit("main"), F.col("p")).alias("link"),
    )


@query("prj8_fetch_urls", """SELECT conv_id, CASE type WHEN 'github' THEN 'https://api.github.com'
   WHEN 'gitlab' THEN 'https://gitlab.com/api/v4' WHEN 'bitbucket' THEN 'https://api.bitbucket.org/2.0' END AS api_base,
  CASE type WHEN 'github' THEN concat('https://api.github.com/repos/', o, '/', r, '/contents/docs/a b.md')
   WHEN 'gitlab' THEN concat('https://gitlab.com/api/v4/projects/', o, '%2F', r, '/repository/files/docs%2Fa%20b.md/raw?ref=main')
   WHEN 'bitbucket' THEN concat('https://api.bitbucket.org/2.0/repositories/', o, '/', r, '/src/main/docs/a b.md') END AS content_url
  FROM (SELECT *, string_split(repo_url, '/')[4] AS o, replace(string_split(repo_url, '/')[5], '.git', '') AS r FROM fx_requests)""",
       ("fx_requests",))
def _(t):
    kind, url = F.col("type"), F.col("repo_url")
    return t("fx_requests").select(
        "conv_id", urls.api_base(kind, url).alias("api_base"),
        urls.content_url(kind, url, F.lit("main"), F.lit("docs/a b.md")).alias("content_url"),
    )


@query("prj9_branches", """SELECT conv_id, CASE WHEN conv_id%3=0 THEN 'main,master' WHEN conv_id%3=1 THEN 'master,main'
   ELSE concat(repo, ',main,master') END AS branches FROM fx_requests""", ("fx_requests",))
def _(t):
    k = F.col("conv_id") % 3
    default = F.when(k == 1, "master").when(k == 2, F.col("repo"))
    return t("fx_requests").select("conv_id", F.array_join(urls.branch_candidates(default), ",").alias("branches"))


@query("prj10_detect_type", """SELECT doc_id, CASE WHEN contains(ref, 'bitbucket.org') THEN 'bitbucket'
   WHEN contains(ref, 'gitlab.com') THEN 'gitlab' WHEN contains(ref, 'github.com') THEN 'github'
   WHEN doc_id%2=0 THEN 'github' ELSE type END AS type FROM fx_references""", ("fx_references",))
def _(t):
    given = F.when(F.col("doc_id") % 2 == 1, F.col("type"))
    return t("fx_references").select("doc_id", urls.detect_type(F.col("ref"), given).alias("type"))


_LANG_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in C.LANGUAGES.items())


@query("prj11_language", """SELECT conv_id, CASE WHEN l.code IS NULL THEN 'en' ELSE language END AS stored,
   coalesce(n.name, 'English') AS language_name, (l.code IS NOT NULL) AS deletable,
   CASE WHEN s.code IS NULL THEN 'en' ELSE s.code END AS from_locale
  FROM fx_requests r LEFT JOIN langs l ON l.code = r.language LEFT JOIN langs n ON n.code = coalesce(r.language, 'en')
  LEFT JOIN langs s ON s.code = lower(string_split(r.language, '-')[1])""",
       ("fx_requests",), ctes=f"langs(code, name) AS (VALUES {_LANG_VALUES})")
def _(t):
    code = F.col("language")
    return t("fx_requests").select(
        "conv_id", urls.language_or_default(code).alias("stored"), urls.language_name(code).alias("language_name"),
        F.coalesce(urls.is_supported(code), F.lit(False)).alias("deletable"), urls.language_of_locale(code).alias("from_locale"),
    )


@query("prj12_cache_key", """SELECT doc_id, concat('wiki_cache_', source, '_own_', lang, '_en.json') AS cache_key,
   concat('wiki_cache_', source, '_own_', lang, '_en_', CASE WHEN doc_id%2=0 THEN 'comprehensive' ELSE 'concise' END) AS view_key
  FROM documents""")
def _(t):
    a = [F.col("source"), F.lit("own"), F.col("lang"), F.lit("en")]
    return t("documents").select(
        "doc_id", urls.cache_key(*a).alias("cache_key"), urls.cache_view_key(*a, F.col("doc_id") % 2 == 0).alias("view_key")
    )


_PARSED = """parsed AS (SELECT *, string_split(replace(replace(name, 'wiki_cache_', ''), '.json', ''), '_') AS p
   FROM fx_cache_names), good AS (SELECT *, starts_with(name, 'wiki_cache_') AND ends_with(name, '.json') AND len(p) >= 4 AS ok
   FROM parsed)"""


@query("prj13_parse_cache_key", """SELECT doc_id, CASE WHEN ok THEN p[1] END AS repo_type, CASE WHEN ok THEN p[2] END AS owner,
   CASE WHEN ok THEN array_to_string(p[3:len(p)-1], '_') END AS repo, CASE WHEN ok THEN p[-1] END AS language FROM good""",
       ("fx_cache_names",), ctes=_PARSED)
def _(t):
    k = t("fx_cache_names").select("doc_id", urls.parse_cache_key(F.col("name")).alias("k"))
    return k.select("doc_id", "k.repo_type", "k.owner", "k.repo", "k.language")
