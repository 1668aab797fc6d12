"""Column expressions against plain Python on many random texts, one Spark job per rule."""

import random
import re
from urllib.parse import quote, unquote

import pytest
from pyspark.sql import functions as F

from repolore.functions import paths, text, urls
from repolore.operators import derive, generate
from repolore.streaming.assemble import event_text


def texts(pieces, n=400, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def check(spark, values, column, want):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    got = {r.i: r.x for r in df.select("i", column.alias("x")).collect()}
    for i, v in enumerate(values):
        assert got[i] == want(v), repr(v)


WHITE = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", " ", " ", "　", "a", "é", "-", "_", "#"]


def test_strip(spark):
    check(spark, texts(WHITE), text.strip(F.col("s")), str.strip)


def test_blank(spark):
    check(spark, texts(WHITE[:13]), text.is_blank(F.col("s")), lambda v: not v.strip())


def test_token_estimate(spark):
    check(spark, texts(WHITE), text.estimate_tokens(F.col("s")), lambda v: len(v.split()))


def test_decode_list(spark):
    values = texts(["a", "/", "%20", "%C3%A9", "%2", "%", "+", "\n", " ", "%zz", "b%41"])
    want = lambda v: [unquote(x) for x in v.split("\n") if x.strip()]
    check(spark, values, paths.decode_list(F.col("s")), want)


def test_quote(spark):
    check(spark, texts(["a", "/", " ", "*", "~", "é", "+", ".", "_", "-", "&", "%"]), urls.quote_all(F.col("s")), lambda v: quote(v, safe=""))


def test_clean_dir(spark):
    check(spark, texts([".", "/", "a", "venv"]), paths.clean_dir(F.col("s")), lambda v: v.strip("./").rstrip("/"))


def test_repo_key(spark):
    def want(v):
        parts = v.rstrip("/").split("/")
        last = parts[-1].replace(".git", "")
        return f"{parts[-2]}_{last}" if len(parts) >= 5 else last

    check(spark, texts(["https:/", "/", "a", "b.git", ".git", "x/y"]), urls.repo_key(F.col("s"), F.lit("gitlab")), want)


def test_summary(spark):
    def want(v):
        m = re.search(r"# [^\n\r  ]*?\n\n([^\n\r  ]*?)(\n\n|\Z)", v)
        return m.group(1).strip() if m else "No summary available"

    check(spark, texts(["# T", "\n\n", "\n", "para", " ", "## x", "\r"]), derive.summary(F.col("s")), want)


@pytest.mark.parametrize("tag", ["markdown", "xml"])
def test_fences(spark, tag):
    def want(v):
        v = re.sub(rf"\A```{tag}[\s]*", "", v, flags=re.I)
        return re.sub(r"```\s*\Z", "", v, count=1)

    check(spark, texts(["```", "xml", "Markdown", "\n", " ", "a", "```xml\n"]), text.strip_fences(F.col("s"), [tag]), want)


def test_event_lines_agree_in_batch_and_stream(spark):
    values = texts(["data: ", '{"choices":[{"delta":{"content":"x"}}]}', '{"choices":[{"text":"t"}]}', '{"choices":[]}', "{bad", ":", " ", "[DONE]",
                    '{"choices":[{"delta":{"content":""},"text":"u"}]}', '{"choices":[{"delta":{}}]}'], 300)
    values = [v for v in values if v.count("{\"choices") <= 1]
    check(spark, values, generate.sse_delta(F.col("s")), lambda v: event_text(v) or None)


def test_force_conclusion_only_when_open(spark):
    values = ["x", "## Summary", "## Summary Next Steps", "In conclusion, y", "Final Conclusion", "Dockerfile The Dockerfile"]
    check(spark, values, derive.force_conclusion(F.col("s"), F.lit(5)) != F.col("s"), lambda v: v in ("x", "## Summary Next Steps"))
