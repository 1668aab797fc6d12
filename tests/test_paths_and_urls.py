"""Examples for path, file and identity rules."""

import pytest
from pyspark.sql import functions as F

from repolore.functions import paths, text, urls

REPO_KEYS = [
    ("https://github.com/owner/repo", "github", "owner_repo"),
    ("https://github.com/owner/repo.git", "github", "owner_repo"),
    ("https://github.com/owner/repo/", "github", "owner_repo"),
    ("https://gitlab.com/owner/repo", "gitlab", "owner_repo"),
    ("https://gitlab.com/group/subgroup/repo", "gitlab", "subgroup_repo"),
    ("https://bitbucket.org/owner/repo", "bitbucket", "owner_repo"),
    ("/home/user/projects/my-repo", "local", "my-repo"),
    ("/var/repos/project.git", "local", "project"),
    ("https://github.com/repo", "github", "repo"),
    ("my-repo", "local", "my-repo"),
]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("url,kind,want", REPO_KEYS)
def test_repo_key(spark, url, kind, want):
    assert one(spark, urls.repo_key(F.col("u"), F.col("k")), u=url, k=kind) == want


@pytest.mark.parametrize(
    "ref,want",
    [
        ("https://github.com/a/b.git", ("a", "b", "github", "a/b", None)),
        ("  gitlab.com/g/s/p/ ", ("s", "p", "gitlab", "g/s/p", None)),
        ("git.corp.io/x/y", ("x", "y", "web", "x/y", None)),
        ("/srv/code/app", ("local", "app", "local", None, "/srv/code/app")),
        ("/", ("local", "local-repo", "local", None, "/")),
        ("C:\\work\\app", ("local", "app", "local", None, "C:\\work\\app")),
        ("justaname", None),
        ("https://github.com", None),
    ],
)
def test_parse_reference(spark, ref, want):
    got = one(spark, urls.parse_reference(F.col("r")), r=ref)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "path,want",
    [("src/a.py", True), ("docs/a.md", False), ("build/x.py", False), ("x/yarn.lock", False), ("x/a.min.js", True)],
)
def test_exclusion_takes_globs_literally(spark, path, want):
    from repolore.operators.corpus import default_excluded_dirs, default_excluded_files

    keep = ~paths.is_excluded(F.col("p"), default_excluded_dirs(), default_excluded_files())
    assert one(spark, keep, p=path) is want


def test_inclusion_overrides_exclusion(spark):
    keep = paths.keep_path(
        F.col("p"), paths.strings(["./src/"]), paths.strings([]), paths.strings(["src"]), paths.strings([])
    )
    assert one(spark, keep, p="src/a.py") is True
    assert one(spark, keep, p="lib/a.py") is False


def test_decode_list_keeps_plus_and_bad_escapes(spark):
    got = one(spark, paths.decode_list(F.col("s")), s="a%20b\n \n+x\n%zz")
    assert got == ["a b", "+x", "%zz"]


def test_strip_and_slug(spark):
    assert one(spark, text.strip(F.col("s")), s="\u00a0\t x y \n\u2003") == "x y"
    assert one(spark, text.slug(F.col("s")), s="Start, now! A_b-c") == "start-now-a_b-c"


def test_tokens(spark):
    assert one(spark, text.estimate_tokens(F.col("s")), s=" a\u2003b\nc ") == 3
    assert one(spark, text.approx_tokens(F.col("s")), s="abcdefghi") == 2



def test_template_braces(spark):
    got = one(spark, text.fill(F.col("s"), {"i": F.lit(3)}), s="a {i} {{i}} {other}")
    assert got == "a 3 {i} {other}"


def test_language(spark):
    assert one(spark, urls.language_of_locale(F.col("s")), s="fr-CA") == "fr"
    assert one(spark, urls.language_of_locale(F.col("s")), s="xx-CA") == "en"
    assert one(spark, urls.language_name(F.col("s")), s="de") == "English"


def test_cache_key_round_trip(spark):
    key = urls.cache_key(F.lit("github"), F.lit("own"), F.col("r"), F.lit("en"))
    got = one(spark, urls.parse_cache_key(key), r="a_b")
    assert tuple(got) == ("github", "own", "a_b", "en")
    assert one(spark, urls.parse_cache_key(F.col("n")), n="wiki_cache_a_b.json") is None
