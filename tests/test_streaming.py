"""Streams fed file by file, so state has to survive micro-batches; results equal the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from repolore.operators import derive, generate
from repolore.operators.ordered import join_text
from repolore.streaming import assemble, jobs, research


@pytest.fixture
def feed(spark, tmp_path):
    """feed(batches, schema): a stream that takes one list of rows per micro-batch."""
    jobs.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def make(batches, schema):
        path = str(tmp_path / "in")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")

    return make


def run(spark, stream, tmp_path, each=lambda b: b, mode="append"):
    out = str(tmp_path / "out")
    jobs.write_batches(stream, out, str(tmp_path / "state"), each, mode).awaitTermination()
    return spark.read.parquet(out)


def run_until(spark, stream, tmp_path, enough, seconds=40):
    """Rows of a stream that goes on, once there are enough of them."""
    out = str(tmp_path / "out")
    query = jobs.write_batches(stream, out, str(tmp_path / "state"), every="100 milliseconds")
    try:
        for _ in range(seconds * 2):
            time.sleep(0.5)
            rows = spark.read.schema(stream.schema).parquet(out + "/batch=*").collect() if query.recentProgress else []
            if enough(rows) or query.exception():
                break
    finally:
        query.stop()
    assert not query.exception()
    return rows


def test_split_event_lines(spark, feed, tmp_path):
    line = 'data: {"choices":[{"delta":{"content":"%s"}}]}\n'
    whole = ": ping\n\n" + line % "Hel" + "data: {bad\n" + line % "lo" + "data: [DONE]\n" + line % "late"
    cuts = [whole[i : i + 11] for i in range(0, len(whole), 11)]
    rows = [(1, i, c) for i, c in enumerate(cuts)]
    batches = [rows[:4], rows[4:5] + rows[2:4], rows[5:]]  # the second batch repeats seen chunks
    deltas = run(spark, assemble.parse_chunks(feed(batches, "response_id bigint, seq bigint, data string")), tmp_path)
    assert join_text(deltas, ["response_id"], ["seq", "line"], "delta").first().text == "Hello"


def answers(n, lines):
    """Raw chunks (response_id, seq, data) of some answers, cut anywhere, and the text of each."""
    import random

    rnd = random.Random(4)
    chunks, texts = [], {}
    for r in range(n):
        words = [f"w{r}-{i} " for i in range(lines)]
        raw = "".join('data: {"choices":[{"delta":{"content":"%s"}}]}\n' % w + rnd.choice(["", ": ping\n", "\n"]) for w in words)
        raw += "data: [DONE]\n" + 'data: {"choices":[{"delta":{"content":"late"}}]}\n'
        cuts = [0, *sorted(rnd.sample(range(1, len(raw)), 25)), len(raw)]
        chunks += [(r, i, raw[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        texts[r] = "".join(words)
    return rnd, chunks, texts


CHUNKS = "response_id bigint, seq bigint, data string"


def test_chunks_come_in_any_order(spark, feed, tmp_path):
    rnd, chunks, texts = answers(5, 30)
    rnd.shuffle(chunks)
    batches = [chunks[i::4] + rnd.sample(chunks, 9) for i in range(4)]  # with repeats
    out = run(spark, assemble.parse_chunks(feed(batches, CHUNKS)), tmp_path)
    assert {r.response_id: r.text for r in join_text(out, ["response_id"], ["seq", "line"], "delta").collect()} == texts
    assert out.where("error IS NOT NULL").count() == 0
    assert assemble.waiting_chunks(spark, str(tmp_path / "state")).count() == 0


def test_chunks_that_wait_are_shown(spark, feed, tmp_path):
    line = 'data: {"choices":[{"delta":{"content":"%s"}}]}\n'
    batches = [[(1, 0, line % "a"), (1, 2, line % "c"), (2, 5, "x")], [(1, 3, line % "d")]]
    out = run(spark, assemble.parse_chunks(feed(batches, CHUNKS)), tmp_path)
    assert [r.delta for r in out.collect()] == ["a"]
    held = assemble.waiting_chunks(spark, str(tmp_path / "state")).collect()
    assert sorted((r.response_id, r.seq) for r in held) == [(1, 2), (1, 3), (2, 5)]


def test_a_gap_that_stays_open_is_an_error(spark, feed, tmp_path):
    line = 'data: {"choices":[{"delta":{"content":"%s"}}]}\n'
    lost = (line % "b")[10:] + line % "c"
    batches = [[(1, 0, line % "a" + (line % "b")[:10]), (1, 2, "tail of a line\n" + line % "d")], [(2, 0, line % "x")], [(1, 1, lost), (1, 3, line % "e")]]
    parsed = assemble.parse_chunks(feed(batches, CHUNKS), gap_ms=1)
    got = run_until(spark, parsed, tmp_path, lambda rows: len(rows) >= 5)
    assert sorted((r.response_id, r.seq, r.line, r.delta, r.error) for r in got) == [(1, 0, 0, "a", None), (1, 1, -1, None, "chunks 1 to 1 did not come"), (1, 2, 1, "d", None), (1, 3, 0, "e", None), (2, 0, 0, "x", None)]


def test_segments_follow_each_other(spark, feed, tmp_path):
    batches = [[(1, 1, "b"), (1, 0, "a"), (2, 0, "x")], [(1, 1, "b"), (1, 2, None), (1, 3, "c")]]
    segs = run(spark, assemble.segments(feed(batches, "response_id bigint, seq bigint, delta string")), tmp_path)
    got = {r.response_id: r.text for r in join_text(segs, ["response_id"], ["from_seq"], "text").collect()}
    assert got == {1: "abc", 2: "x"} and segs.where("response_id = 1").count() == 2


def test_late_rows_are_kept(spark, feed, tmp_path):
    batches = [[(1, 0, "a"), (1, 2, "c")], [(1, 1, "b"), (1, 3, "d"), (1, 2, "c")]]
    segs = run(spark, assemble.segments(feed(batches, "response_id bigint, seq bigint, delta string")), tmp_path)
    assert join_text(segs, ["response_id"], ["from_seq"], "text").first().text == "abcd"


def test_many_lines_in_a_chunk(spark, feed, tmp_path):
    line = 'data: {"choices":[{"delta":{"content":"x"}}]}\n'
    rows = [[(1, i, line * 1500)] for i in range(2)]
    deltas = run(spark, assemble.parse_chunks(feed(rows, "response_id bigint, seq bigint, data string")), tmp_path)
    assert deltas.select("seq", "line").distinct().count() == 3000


def test_growing_text_shows_stages(spark, feed, tmp_path):
    batches = [[(1, 0, "## Research ")], [(1, 1, "Plan\nfirst")], [(1, 2, " then")]]
    grown = assemble.growing_text(feed(batches, "response_id bigint, seq bigint, delta string"))
    view = grown.select(F.col("response_id").alias("conv_id"), F.lit(1).cast("bigint").alias("iteration"), "seq", "text")
    out = str(tmp_path / "log")
    jobs.live_stages(view, out, str(tmp_path / "state")).awaitTermination()
    log = spark.read.parquet(out)
    assert log.count() == 2
    assert [(r.type, r.content) for r in derive.upsert_stages(log).collect()] == [("plan", "## Research Plan\nfirst then")]


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_runs_hold_each_text_once(spark, feed, tmp_path, seed):
    import random

    rng = random.Random(seed)
    texts = {
        (1, 1): "intro ## Research Plan\nsteps ## Final Conclusion", (1, 2): "## Final Conclusion first, ## Research Update 2 later",
        (2, 1): "nothing to see", (2, 7): "x" * 50 + "## Research Update 7 ## Final Conclusion" + "y" * 40, (3, 3): "## Research Update",
    }
    rows = [(c, i, seq, t[at:at + 5]) for (c, i), t in texts.items() for seq, at in enumerate(range(0, len(t), 5))]
    rng.shuffle(rows)
    batches = [rows[k::4] + rows[:3] for k in range(4)]  # out of order, with repeats
    deltas = feed(batches, "conv_id bigint, iteration bigint, seq bigint, delta string")
    log = run(spark, assemble.stage_runs(deltas, keys=["conv_id", "iteration"]), tmp_path).drop("batch")
    whole = {(r.conv_id, r.iteration): r.text for r in join_text(log, ["conv_id", "iteration"], ["from_seq"], "text").collect()}
    assert whole == texts

    def kind(i, t):
        if i == 1 and "## Research Plan" in t:
            return "plan"
        return "update" if 1 <= i <= 4 and f"## Research Update {i}" in t else "conclusion" if "## Final Conclusion" in t else None

    expected = {}
    for (c, i), t in texts.items():
        for end in range(5, len(t) + 5, 5):
            if kind(i, t[:end]):
                expected[c, i, kind(i, t[:end])] = t[:end]
    got = derive.stage_texts(log, ["conv_id", "iteration"]).collect()
    assert {(r.conv_id, r.iteration, r.type): r.content for r in got} == expected and len(got) == len(expected)
    assert {r.title for r in got} == {"Research Plan", "Research Update 2", "Final Conclusion"}


def test_in_flight_pages_pass_once(spark, feed, tmp_path):
    schema = "ts timestamp, wiki_id string, page_id string"
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    late = t0 + dt.timedelta(hours=5)
    batches = [[(t0, "w", "p"), (t0, "w", "p"), (t0, "w", "q")], [(t0, "w", "p")], [(late, "w", "z")], [(late, "w", "y")],
               [(late, "w", "p")]]
    got = run(spark, jobs.in_flight_once(feed(batches, schema), "1 hour"), tmp_path)
    assert sorted(r.page_id for r in got.collect()) == ["p", "p", "q", "y", "z"]  # the last 'p' came after the hold


def test_a_finished_page_can_be_asked_for_again(spark, feed, tmp_path):
    import datetime as dt

    t0, minute = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)

    def at(i, seq, page, kind="request"):
        return (t0 + i * minute, seq, "w", page, kind)

    batches = [[at(0, 1, "p"), at(1, 2, "p"), at(0, 3, "q")], [at(2, 4, "p", "finish"), at(3, 5, "p"), at(3, 6, "p")],
               [at(4, 7, "q"), at(5, 8, "q", "finish"), at(5, 9, "q")], [at(90, 10, "p"), at(91, 11, "p")], [at(200, 12, "p", "finish"), at(200, 13, "p")]]
    events = feed(batches, "ts timestamp, seq bigint, wiki_id string, page_id string, kind string")
    got = run(spark, jobs.in_flight(events, hold_ms=60 * 60_000), tmp_path)
    # 5 passes because 4 finished the page, 10 because the hold of 5 is over
    assert sorted(r.seq for r in got.collect()) == [1, 3, 5, 9, 10, 13]


def test_failures_are_rows(spark, feed, tmp_path):
    s = feed([[(1, "fine")], [(2, "boom")], [(3, "fine too")]], "id bigint, prompt string")
    out = str(tmp_path / "o")
    jobs.live_answers(s, lambda: generate.EchoGenerator(poison="boom"), out, str(tmp_path / "c")).awaitTermination()
    got = {r.id: r.shown for r in spark.read.parquet(out).collect()}
    assert got == {1: "echo: fine", 2: "\nError: model unavailable", 3: "echo: fine too"}


def test_round_tracker(spark, feed, tmp_path):
    go, end = "more", "## Final Conclusion"
    batches = [[(1, 0, go), (2, 0, go)], [(1, 1, go), (2, 1, end)], [(1, 2, go), (1, 3, go), (2, 2, go)], [(1, 4, go), (1, 5, go)]]
    got = run(spark, research.next_steps(feed(batches, "conv_id bigint, seq bigint, content string")), tmp_path)
    rows = sorted((r.conv_id, r.iteration, r.complete) for r in got.collect())
    assert rows == [(1, 1, False), (1, 2, False), (1, 3, False), (1, 4, False), (1, 5, True), (2, 1, False), (2, 2, True)]


def test_research_rounds_stop_when_complete(spark):
    m = spark.createDataFrame(
        [(1, 0, "user", "[DEEP RESEARCH] topic"), (2, 0, "user", "[DEEP RESEARCH] stop here"), (3, 0, "user", "plain")],
        "conv_id bigint, turn bigint, role string, content string",
    )

    def prompts(state):
        text = F.when(F.col("query").contains("stop"), "In conclusion, done").otherwise(F.concat(F.lit("on "), "query"))
        return state.select("conv_id", text.alias("prompt"))

    rows = research.run_rounds(m, prompts, generate.EchoGenerator).collect()
    assert sorted((r.conv_id, r.iteration, r.complete) for r in rows) == [
        (1, 1, False), (1, 2, False), (1, 3, False), (1, 4, False), (1, 5, True), (2, 1, True)]
    last = next(r for r in rows if r.conv_id == 1 and r.iteration == 5)
    assert last.content.startswith("echo: on topic") and "## Final Conclusion" in last.content
