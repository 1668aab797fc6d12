"""Tree scan, stores, cache and exports on temporary folders."""

import json

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from repolore.operators import corpus
from repolore.sources import exports, stores, tree
from repolore.sources.buckets import BucketStore


@pytest.fixture
def roots(spark, tmp_path):
    def put(path, data):
        f = tmp_path / "r1" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)

    put("pkg/__init__.py", b"x = 1\r\ny = 2\n")
    put("_notes/a.md", b"n")
    put(".git/b.py", b"hidden")
    put("docs/c.md", b"excluded")
    put("pkg/.d.py", b"hidden")
    put("pkg/latin.py", "é".encode("latin-1"))
    put("pkg/empty.py", b"")
    put("pkg/image.png", b"p")
    put("pkg/deep/er/e.go", "ü".encode())
    return spark.createDataFrame([("r1", str(tmp_path / "r1"))], "repo string, root string")


def test_scan(roots):
    got = {r.file_path: r.text for r in tree.scan(roots, tasks=3).collect()}
    assert got == {"pkg/__init__.py": "x = 1\ny = 2\n", "_notes/a.md": "n", "pkg/empty.py": "", "pkg/deep/er/e.go": "ü"}


def _shop(uri):
    """A store that only its own client opens: shop://<folder>."""
    return fs.SubTreeFileSystem(uri.removeprefix("shop://").rsplit("/", 1)[0], fs.LocalFileSystem()), uri.rsplit("/", 1)[1]


def test_scan_of_a_store_without_mount(roots):
    far = roots.withColumn("root", F.concat(F.lit("shop://"), "root"))
    want = sorted(map(tuple, tree.scan(roots).collect()))
    assert want and sorted(map(tuple, tree.scan(far, connect=_shop).collect())) == want
    only = tree.scan(far, included_dirs=["docs"], included_files=[".go"], connect=_shop)
    assert {r.file_path for r in only.collect()} == {"docs/c.md", "pkg/deep/er/e.go"}
    assert tree.scan(far.withColumn("root", F.lit("shop:///nowhere/r1")), connect=_shop).count() == 0


def _unreachable(uri):
    raise OSError("no answer")


def test_a_store_that_does_not_answer_is_no_empty_store(roots):
    with pytest.raises(Exception, match="no answer"):
        tree.scan(roots.withColumn("root", F.lit("shop://x/r1")), connect=_unreachable).count()


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_scan_with_spark(spark, roots, tmp_path, scheme):
    odd = tmp_path / "r 2+é" / "a b" / "c+d%20.md"
    odd.parent.mkdir(parents=True)
    odd.write_text("1\r2\r\n")
    (tmp_path / "loose.md").write_text("in no repository")
    got = tree.scan_with_spark(spark, scheme + str(tmp_path))
    want = {("r1", "pkg/deep/er/e.go", "ü"), ("r 2+é", "a b/c+d%20.md", "1\n2\n")}
    assert {tuple(r) for r in got.collect()} == want  # empty files and '_' names are hidden by Spark's reader


def test_files_against_the_rules_are_not_opened(spark, roots, tmp_path):
    got = tree.scan_with_spark(spark, str(tmp_path), included_dirs=["docs"])
    rows = got._jdf.queryExecution().executedPlan().executeCollect()
    assert len(rows) == 1
    leaf = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().get("numFiles").get().value() == 1


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / "r" / f"d{i}").mkdir(parents=True)
        (tmp_path / "r" / f"d{i}" / "a.md").write_text(str(i))
    sc, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, setting = set(sc.statusTracker().getJobIdsForGroup()), spark.conf.get(name)
    got = tree.scan_with_spark(spark, str(tmp_path))
    jobs = set(sc.statusTracker().getJobIdsForGroup()) - before
    stages = [sc.statusTracker().getStageInfo(x) for j in jobs for x in sc.statusTracker().getJobInfo(j).stageIds]
    assert stages and sum(x.numTasks for x in stages) <= 4 * sc.defaultParallelism
    assert spark.conf.get(name) == setting and got.count() == 300


def test_scan_with_inclusion(roots):
    got = {r.file_path for r in tree.scan(roots, included_dirs=["docs"], included_files=[".go"]).collect()}
    assert got == {"docs/c.md", "pkg/deep/er/e.go"}


def test_scan_of_a_missing_root_is_empty(spark):
    gone = spark.createDataFrame([("r", "/no/such/folder")], "repo string, root string")
    assert tree.scan(gone).count() == 0


def test_chunk_store_is_idempotent_and_reused(spark, tmp_path):
    path = str(tmp_path / "store")
    files = spark.createDataFrame([("a", "one two"), ("b", "three")], "repo string, text string")

    def build(f):
        return corpus.chunk_words(f).select("repo", "ord", "text")

    assert stores.reuse_chunks(files, path, build).count() == 2  # nothing stored yet
    stores.write_chunks(build(files.where("repo = 'a'")), path)
    stores.write_chunks(build(files.where("repo = 'a'")), path)
    stores.write_chunks(build(files.where("repo = 'b'")).withColumn("text", F.lit("old")), path)
    got = {(r.repo, r.text) for r in stores.reuse_chunks(files, path, build).collect()}
    assert got == {("a", "one two"), ("b", "old")}


def _cache(spark, path, title="T"):
    w = spark.createDataFrame(
        [("w1", "github", "o", "r", "en", title, "p", "m")],
        "wiki_id string, repo_type string, owner string, repo string, language string, title string, provider string, model string",
    )
    pages = spark.createDataFrame(
        [("w1", 0, "p1", "P", "high", "c\nd", ["f"], ["x"])],
        "wiki_id string, pos bigint, id string, title string, importance string, content string, file_paths array<string>, related array<string>",
    )
    stores.upsert_cache(stores.cache_rows(w, pages, "2024-01-01"), path)
    return w.select(*stores.CACHE_KEY)


def test_cache_upsert_lookup_delete(spark, tmp_path):
    path = str(tmp_path / "cache")
    keys = _cache(spark, path)
    _cache(spark, path, "T2")
    assert [(r.title, r.n_pages) for r in stores.lookup_cache(keys, path).collect()] == [("T2", 1)]
    assert [r.name for r in stores.cache_objects(spark, path).collect()] == ["wiki_cache_github_o_r_en.json"]
    assert [r.status for r in stores.delete_cache(keys, path).collect()] == ["deleted"]
    assert [r.status for r in stores.delete_cache(keys, path).collect()] == ["not found"]
    assert [r.title for r in stores.lookup_cache(keys, path).collect()] == [None]
    assert stores.cache_objects(spark, path).count() == 0
    refused = keys.withColumn("language", F.lit("xx"))
    assert [r.status for r in stores.delete_cache(refused, path).collect()] == ["unsupported language"]


def test_corrupt_record_reads_as_absent(spark, tmp_path):
    path = tmp_path / "cache"
    keys = _cache(spark, str(path))
    part = next(path.glob("data/v=*/bucket=*/part-*.json"))
    lines = part.read_text().splitlines()
    part.with_name("." + part.name + ".crc").unlink()
    part.write_text("\n".join([lines[0], lines[1][:20]]) + "\n")
    assert [r.title for r in stores.lookup_cache(keys, str(path)).collect()] == [None]


def _records(spark, names, text, schema="k string, pos bigint, text string"):
    return spark.createDataFrame([(k, i, f"{text} {k} {i}") for k in names for i in range(2)], schema)


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, str(tmp_path / "store"), ("k",), "k string, pos bigint, text string", {"last": F.max("pos")}, 8)


def _held(df):
    return sorted((r.k, r.pos, r.text) for r in df.collect())


def test_buckets_hold_any_number_of_keys(spark, tmp_path, store):
    many = spark.range(20_000).selectExpr("concat('k', id) as k", "0L as pos", "'t' as text")
    store.write(many)
    store.write(many.limit(5_000).withColumn("text", F.lit("u")))
    folders = list((tmp_path / "store").glob("data/v=*/bucket=*"))
    assert len(folders) <= 16 and store.index().count() == 20_000 and store.read().where("text = 'u'").count() == 5_000
    one = store.read(spark.createDataFrame([("k7",)], "k string"))
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 1 and one.count() == 1


def test_the_index_opens_no_record(spark, tmp_path, store):
    store.write(_records(spark, "abc", "one"))
    for f in (tmp_path / "store").glob("data/v=*/bucket=*/*"):
        f.unlink()
    assert sorted((r.k, r.n_rows, r.last) for r in store.index().collect()) == [(k, 2, 1) for k in "abc"]
    assert store.read().count() == 0  # records without their rows are absent


def test_records_are_replaced_and_deleted_whole(spark, store):
    store.write(_records(spark, "abcdef", "one"))
    store.write(_records(spark, "bd", "two").where("pos = 0"))
    want = _records(spark, "acef", "one").collect() + _records(spark, "bd", "two").where("pos = 0").collect()
    assert _held(store.read()) == sorted(map(tuple, want))
    store.delete(spark.createDataFrame([("a",), ("b",), ("nobody",)], "k string"))
    assert _held(store.read()) == sorted(tuple(r) for r in want if r.k not in "ab")
    store.delete(spark.createDataFrame([(k,) for k in "cdef"], "k string"))
    assert store.read().count() == store.index().count() == 0
    store.write(_records(spark, [], "none"))
    store.write(_records(spark, "a", "again"))
    assert _held(store.read()) == _held(_records(spark, "a", "again"))


def test_a_writer_that_fails_leaves_the_old_version(spark, store):
    store.write(_records(spark, "abc", "one"))
    torn = _records(spark, "abxyz", "two").withColumn("text", F.when(F.col("k") == "z", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.write(torn)
    store._put(_records(spark, "abq", "left behind"), "data", store._next(), "json", "append")  # as a writer that died before its commit
    assert _held(store.read()) == _held(_records(spark, "abc", "one"))
    store.write(_records(spark, "c", "three"))
    assert _held(store.read()) == sorted(_held(_records(spark, "ab", "one")) + _held(_records(spark, "c", "three")))
    with pytest.raises(ValueError, match="8 buckets"):
        BucketStore(spark, store.path, store.keys, store.schema, store.about, 9).read()


def test_lookup_without_a_store(spark, tmp_path):
    keys = spark.createDataFrame([("github", "o", "r", None)], "repo_type string, owner string, repo string, language string")
    got = stores.lookup_cache(keys, str(tmp_path / "none")).collect()
    assert [(r.language, r.title) for r in got] == [("en", None)]


@pytest.fixture(scope="module")
def wiki_tables(spark):
    wikis = spark.createDataFrame([("w", "https://x/o/w/")], "wiki_id string, repo_url string")
    pages = spark.createDataFrame(
        [("w", 1, "p1", "One", "high", "body\n", ["f"], ["p2", "gone"]), ("w", 2, "p2", "Two", "low", "b2", [], ["gone"]),
         ("w", 3, "p3", "Three", "low", "b3", [], [])],
        "wiki_id string, pos bigint, id string, title string, importance string, content string, file_paths array<string>, related array<string>",
    )
    return wikis, pages


WANT = (
    "# Wiki Documentation for https://x/o/w/\n\nGenerated on: NOW\n\n## Table of Contents\n\n"
    "- [One](#p1)\n- [Two](#p2)\n- [Three](#p3)\n\n"
    "<a id='p1'></a>\n\n## One\n\n### Related Pages\n\nRelated topics: [Two](#p2)\n\nbody\n\n\n---\n\n"
    "<a id='p2'></a>\n\n## Two\n\n### Related Pages\n\nb2\n\n---\n\n"
    "<a id='p3'></a>\n\n## Three\n\nb3\n\n---\n\n"
)


def test_markdown_files_hold_the_document(wiki_tables, tmp_path):
    parts = exports.markdown_parts(*wiki_tables, "NOW")
    rows = sorted(parts.collect(), key=lambda r: (r.block, r.pos))
    assert "".join(r.text for r in rows) == WANT
    exports.write_parts(parts.repartition(3), str(tmp_path / "md"))
    files = sorted((tmp_path / "md" / "wiki_id=w").glob("part-*"))
    assert "".join(f.read_text() for f in files) == WANT
    back = exports.read_parts(parts.sparkSession, str(tmp_path / "md"))
    assert [(r.wiki_id, r.block, r.document) for r in back.collect()] == [("w", 0, WANT)]


def test_json_document(wiki_tables):
    d = json.loads(exports.json_documents(*wiki_tables, "NOW").first().document)
    assert d["metadata"] == {"repository": "https://x/o/w/", "generated_at": "NOW", "page_count": 3}
    assert [p["id"] for p in d["pages"]] == ["p1", "p2", "p3"] and d["pages"][0]["relatedPages"] == ["p2", "gone"]
    small = exports.json_documents(*wiki_tables, "NOW", cell_chars=5, block_chars=40).orderBy("block").collect()
    assert [r.block for r in small] == list(range(len(small))) and len(small) > 2
    assert json.loads("".join(r.document for r in small)) == d


def test_file_name_and_documents(spark, wiki_tables, tmp_path):
    name = wiki_tables[0].select(exports.file_name(F.col("repo_url"), "s", "md").alias("n")).first().n
    assert name == "w_wiki_s.md"
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "id string, text string")
    exports.write_documents(docs, "id", "text", str(tmp_path / "d"))
    assert next((tmp_path / "d" / "id=a").glob("part-*")).read_text() == "x\ny\n"
