"""Repository addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolore import constants as C
from repolore.functions.text import strip

# scheme, host, port, path of a web address; user info is skipped
_WEB = r"^(https?)://(?:[^/?#@]*@)?([^/:?#\s]+)(:[0-9]*)?(/[^?#]*)?([?#].*)?$"


def _with_scheme(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _WEB, group)


def host(url: Column) -> Column:
    return F.when(url.rlike(_WEB), F.lower(_part(url, 2)))


def domain(c: Column) -> Column:
    """``scheme://host[:port]`` with ``https`` assumed; default ports dropped; null for no web address."""
    u = _with_scheme(c)
    port = _part(u, 3)
    default = F.when(_part(u, 1) == "https", ":443").otherwise(":80")
    shown = F.when((port == default) | (port == ":"), "").otherwise(port)
    return F.when(u.rlike(_WEB), F.concat(_part(u, 1), F.lit("://"), F.lower(_part(u, 2)), shown))


def path(c: Column) -> Column:
    """Path without one leading and one trailing slash."""
    u = _with_scheme(c)
    return F.when(u.rlike(_WEB), F.regexp_replace(_part(u, 4), r"^/|/$", ""))


def repo_key(url: Column, repo_type: Column) -> Column:
    """``owner_repo`` for hosted addresses of at least five parts, else the last part; every '.git' removed."""
    parts = F.split(F.regexp_replace(url, r"/+$", ""), "/")
    last = F.replace(F.element_at(parts, -1), F.lit(".git"), F.lit(""))
    hosted = repo_type.isin(C.HOSTED_TYPES) & (F.size(parts) >= 5)
    return F.when(hosted, F.concat(F.get(parts, F.size(parts) - 2), F.lit("_"), last)).otherwise(last)


def parse_reference(text: Column) -> Column:
    """User input to ``struct(owner, repo, type, full_path, local_path)``; null when it names no repository."""
    s = strip(text)
    windows = s.rlike(C.WINDOWS_PATH)
    unix = F.startswith(s, F.lit("/"))
    web = s.rlike(C.REPO_URL)
    dom = F.coalesce(domain(s), F.lit(""))
    kind = (
        F.when(windows | unix, "local")
        .when(dom.contains("github.com"), "github")
        .when(dom.contains("gitlab.com") | dom.contains("gitlab."), "gitlab")
        .when(dom.contains("bitbucket.org") | dom.contains("bitbucket."), "bitbucket")
        .otherwise("web")
    )
    full = F.regexp_replace(path(s), r"\.git$", "")
    parts = F.split(full, "/")
    last_windows = F.element_at(F.split(s, r"\\"), -1)
    last_unix = F.try_element_at(F.filter(F.split(s, "/"), lambda x: x != ""), F.lit(-1))
    last_local = F.when(windows, last_windows).otherwise(last_unix)
    local_repo = F.coalesce(F.nullif(last_local, F.lit("")), F.lit("local-repo"))
    repo = F.when(windows | unix, local_repo).when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 1))
    owner = F.when(windows | unix, F.lit("local")).when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    repo_clean = F.regexp_replace(strip(repo), r"\.git$", "")
    ok = (windows | unix | web) & (F.coalesce(repo, F.lit("")) != "") & (F.coalesce(owner, F.lit("")) != "")
    return F.when(
        ok,
        F.struct(
            strip(owner).alias("owner"),
            repo_clean.alias("repo"),
            kind.alias("type"),
            F.when(~(windows | unix), full).alias("full_path"),
            F.when(windows | unix, s).alias("local_path"),
        ),
    )


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def canonical_url(repo_type: Column, local_path: Column, repo_url: Column, owner: Column, repo: Column) -> Column:
    return (
        F.when((repo_type == "local") & _given(local_path), local_path)
        .when(_given(repo_url), repo_url)
        .when(_given(owner) & _given(repo), F.concat(F.lit("http://example/"), owner, F.lit("/"), repo))
        .otherwise("")
    )


def file_link(repo_type: Column, repo_url: Column, branch: Column, file_path: Column) -> Column:
    h = F.coalesce(host(repo_url), F.lit(""))

    def link(middle: str) -> Column:
        return F.concat(repo_url, F.lit(middle), branch, F.lit("/"), file_path)

    return (
        F.when((repo_type == "local") | ~_given(repo_url), file_path)
        .when(h.contains("github"), link("/blob/"))
        .when(h.contains("gitlab"), link("/-/blob/"))
        .when(h.contains("bitbucket"), link("/src/"))
        .otherwise(file_path)
    )


def detect_type(repo_url: Column, given: Column) -> Column:
    u = F.coalesce(repo_url, F.lit(""))
    return (
        F.when(u.contains("bitbucket.org"), "bitbucket")
        .when(u.contains("gitlab.com"), "gitlab")
        .when(u.contains("github.com"), "github")
        .otherwise(F.coalesce(F.nullif(given, F.lit("")), F.lit("github")))
    )


def api_base(repo_type: Column, repo_url: Column) -> Column:
    """Where a repository's API lives: public host or the enterprise form of the same host."""
    d = domain(repo_url)
    return (
        F.when((repo_type == "github") & (host(repo_url) == "github.com"), "https://api.github.com")
        .when(repo_type == "github", F.concat(d, F.lit("/api/v3")))
        .when(repo_type == "gitlab", F.concat(d, F.lit("/api/v4")))
        .when(repo_type == "bitbucket", "https://api.bitbucket.org/2.0")
    )


def quote_all(c: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_ . - ~``."""
    e = F.url_encode(c)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def content_url(repo_type: Column, repo_url: Column, branch: Column, file_path: Column) -> Column:
    """Address of one file's content in the provider's API."""
    p = path(repo_url)
    parts = F.split(p, "/")
    owner = F.get(parts, F.size(parts) - 2)
    repo = F.replace(F.get(parts, F.size(parts) - 1), F.lit(".git"), F.lit(""))
    base = api_base(repo_type, repo_url)
    return (
        F.when(F.size(parts) < 2, None)
        .when(
            repo_type == "github",
            F.concat(base, F.lit("/repos/"), owner, F.lit("/"), repo, F.lit("/contents/"), file_path),
        )
        .when(
            repo_type == "gitlab",
            F.concat(
                base, F.lit("/projects/"), quote_all(F.replace(p, F.lit(".git"), F.lit(""))),
                F.lit("/repository/files/"), quote_all(file_path), F.lit("/raw?ref="), branch,
            ),
        )
        .when(
            repo_type == "bitbucket",
            F.concat(base, F.lit("/repositories/"), owner, F.lit("/"), repo, F.lit("/src/"), branch, F.lit("/"), file_path),
        )
    )


def branch_candidates(default: Column) -> Column:
    d = F.nullif(default, F.lit(""))
    return F.array_distinct(F.array_compact(F.array(d, F.lit("main"), F.lit("master"))))


def _language_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in C.LANGUAGES.items() for x in kv])


def is_supported(code: Column) -> Column:
    return code.isin(list(C.LANGUAGES))


def language_or_default(code: Column) -> Column:
    return F.when(is_supported(code), code).otherwise(C.DEFAULT_LANGUAGE)


def language_name(code: Column) -> Column:
    wanted = F.coalesce(F.nullif(code, F.lit("")), F.lit(C.DEFAULT_LANGUAGE))
    return F.coalesce(F.try_element_at(_language_map(), wanted), F.lit("English"))


def language_of_locale(locale: Column) -> Column:
    """``xx-YY`` to ``xx`` when supported, else the default."""
    return language_or_default(F.lower(F.element_at(F.split(locale, "-"), 1)))


def cache_key(repo_type: Column, owner: Column, repo: Column, language: Column) -> Column:
    return F.concat(F.lit(C.CACHE_PREFIX), F.concat_ws("_", repo_type, owner, repo, language), F.lit(".json"))


def cache_view_key(repo_type: Column, owner: Column, repo: Column, language: Column, comprehensive: Column) -> Column:
    view = F.when(comprehensive, "comprehensive").otherwise("concise")
    return F.concat(F.lit(C.CACHE_PREFIX), F.concat_ws("_", repo_type, owner, repo, language, view))


def parse_cache_key(key: Column) -> Column:
    """Name to ``struct(repo_type, owner, repo, language)``; null for other names. An owner with '_' is mis-split."""
    body = F.replace(F.replace(key, F.lit(C.CACHE_PREFIX), F.lit("")), F.lit(".json"), F.lit(""))
    p = F.split(body, "_")
    ok = F.startswith(key, F.lit(C.CACHE_PREFIX)) & F.endswith(key, F.lit(".json")) & (F.size(p) >= 4)
    return F.when(
        ok,
        F.struct(
            F.get(p, F.lit(0)).alias("repo_type"),
            F.get(p, F.lit(1)).alias("owner"),
            F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 3, F.lit(0))), "_").alias("repo"),
            F.get(p, F.size(p) - 1).alias("language"),
        ),
    )
