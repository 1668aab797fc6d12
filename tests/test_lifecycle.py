"""Whole jobs on a small repository."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from repolore.operators import embed, generate
from repolore.operators.generate import Reply
from repolore.plans import lifecycle
from repolore.sources import stores


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, "r1", f"src/f{i}.py", f"text number {i % 4}") for i in range(8)]
    rows += [(20, "r1", "docs/x.md", "excluded"), (21, "r2", "README.md", "# Read\nme"), (22, "r2", "a.png", "no")]
    return spark.createDataFrame(rows, "doc_id bigint, repo string, file_path string, text string")


class Counting(embed.HashEmbedder):
    """Fails when asked twice for a text: the store has to answer."""

    def __call__(self, texts):
        assert len(set(texts)) == len(texts)
        return super().__call__(texts)


class Forbidden(embed.HashEmbedder):
    def __call__(self, texts):
        raise AssertionError("nothing should be embedded again")


def test_index_embeds_each_text_once(spark, files, tmp_path):
    a, b = str(tmp_path / "chunks"), str(tmp_path / "vectors")
    left = lifecycle.build_index(files, a, b, "m", partial(Counting, 8))
    assert left.count() == 0
    assert spark.read.parquet(b).count() == 5
    lifecycle.build_index(files, a, b, "m", partial(Forbidden, 8))
    assert spark.read.parquet(b).count() == 5
    model = embed.HashEmbedder(8)
    assert all(list(model([r.text])[0]) == r.vector for r in spark.read.parquet(a).collect())
    assert {(r.repo, r.n) for r in spark.read.parquet(a).groupBy("repo").agg(F.count("*").alias("n")).collect()} == {("r1", 8), ("r2", 1)}


class Planner:
    def __call__(self, prompt):
        name = prompt.split("repository ", 1)[1].split(".", 1)[0]
        assert "<file_tree>" in prompt and ("# Read" in prompt) == (name == "r2")
        if name == "r2":
            return Reply("no plan")
        return Reply(
            "```xml\n<wiki_structure><title>T & U</title><description>d</description><sections><section id='s1'><title>S</title>"
            "<pages><page_ref>p1</page_ref></pages></section></sections><pages><page id='p1'><title>One</title><importance>high</importance>"
            "<relevant_files><file_path>src/f1.py</file_path></relevant_files></page><page id='p2'><title>Two boom</title></page></pages>"
            "</wiki_structure>\n```"
        )


class Writer:
    def __call__(self, prompt):
        if "boom" in prompt:
            raise RuntimeError("offline")
        assert "- [src/f1.py](https://github.com/o/r1/blob/main/src/f1.py)" in prompt
        return Reply("```markdown\n# One\ntext\n```")


def test_wikis_are_planned_and_written(spark, files):
    repos = spark.createDataFrame(
        [(r, "github", f"https://github.com/o/{r}", "main") for r in ("r1", "r2")],
        "repo string, type string, repo_url string, branch string",
    )
    pages, sections = lifecycle.write_wikis(files, repos, Planner, Writer)
    got = {r.id: (r.wiki_id, r.importance, r.content) for r in pages.collect()}
    assert got == {"p1": ("r1", "high", "# One\ntext\n"), "p2": ("r1", "medium", "Error generating content: offline")}
    assert [(r.wiki_id, r.section_id, r.page_ids) for r in sections.collect()] == [("r1", "s1", ["p1"])]


class NoPlanner:
    def __call__(self, prompt):
        raise RuntimeError("busy")


def test_a_failed_plan_is_a_page(spark, files):
    repos = spark.createDataFrame([("r1", "github", "u", "main")], "repo string, type string, repo_url string, branch string")
    pages, _ = lifecycle.write_wikis(files, repos, NoPlanner, Writer)
    assert [(r.wiki_id, r.id, r.content) for r in pages.collect()] == [("r1", "plan", "Error generating content: busy")]


def test_long_prompts_are_answered_without_context(spark, files, tmp_path):
    a, b = str(tmp_path / "chunks"), str(tmp_path / "vectors")
    lifecycle.build_index(files, a, b, "m", partial(embed.HashEmbedder, 8))
    requests = spark.createDataFrame(
        [(1, "r1", "u/r1", "github", "google", "en", None), (2, "r1", "u/r1", "github", "google", "en", None),
         (3, "r1", "u/r1", "github", "google", "en", None)],
        "conv_id bigint, repo string, repo_url string, type string, provider string, language string, file_path string",
    )
    messages = spark.createDataFrame(
        [(1, 0, "user", "hello"), (2, 0, "user", "hello"), (2, 1, "assistant", "x")],
        "conv_id bigint, turn bigint, role string, content string",
    )
    vectors = stores.read_chunks(spark, a, spark.read.parquet(a).schema)
    ready = {r.conv_id: r for r in lifecycle.prompts(requests, messages, files, vectors, partial(embed.HashEmbedder, 8)).collect()}
    assert "## File Path: src/f" in ready[1].prompt and "size constraints" in ready[1].short_prompt
    assert (ready[2].rejected, ready[3].rejected) == ("Last message must be from the user", "No messages provided")
    limit = len(ready[1].short_prompt.split())
    out = lifecycle.answer_requests(
        requests, messages, files, vectors, partial(embed.HashEmbedder, 8), partial(generate.EchoGenerator, limit)
    )
    got = {r.conv_id: (r.error_code, r.response) for r in out.collect()}
    assert got[1][0] is None and got[1][1].startswith("echo: /no_think You explain")
    assert got[3] == (400, "No messages provided")
