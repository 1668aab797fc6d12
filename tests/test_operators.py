"""Operators on small inputs, against brute force or golden rows; skewed inputs included."""

import os
import time
import uuid
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolore.operators import blocks, converse, corpus, derive, embed, generate, packs, retrieve, wiki
from repolore.operators.ordered import join_text, text_blocks
from repolore.plans import flagship
from repolore.session import cut_lineage
from repolore.sources import colocated, exports, stores


def test_chunks_rejoin_to_the_text(spark):
    words = [f"w{i}" for i in range(1234)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, "")], "doc_id bigint, text string")
    rows = corpus.chunk_words(docs).orderBy("doc_id", "ord").collect()
    big = [r.text.split(" ") for r in rows if r.doc_id == 1]
    assert len(big) == 5 and all(len(c) == 350 for c in big[:-1])
    assert big[0] + [w for c in big[1:] for w in c[100:]] == words
    assert [r.text for r in rows if r.doc_id > 1] == ["a b", ""]


@pytest.fixture(scope="module")
def vectors(spark):
    """One repository holds most chunks, and most of those are copies of one vector."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8).astype("float32")
    rows = []
    for i in range(900):
        v = base if i % 3 else rng.standard_normal(8).astype("float32")
        rows.append((i, "hot" if i < 700 else f"r{i % 5}", [float(x) for x in v]))
    chunks = spark.createDataFrame(rows, "chunk_id bigint, repo string, vector array<float>")
    qs = [(q, "hot" if q < 20 else f"r{q % 5}", [float(x) for x in rng.standard_normal(8).astype("float32")]) for q in range(40)]
    return rows, qs, chunks, spark.createDataFrame(qs, "query_id bigint, repo string, vector array<float>")


def _brute(rows, qs, k):
    want = set()
    for q, repo, v in qs:
        scored = sorted((-round(float(np.dot(np.float64(v), np.float64(w))), 6), c) for c, r, w in rows if r == repo)
        want |= {(q, c, i + 1) for i, (_, c) in enumerate(scored[:k])}
    return want


@pytest.mark.parametrize("few", [True, False])
def test_search_equals_brute_force(vectors, few):
    rows, qs, chunks, queries = vectors
    got = retrieve.search(queries, chunks.repartition(5), 7, few, chunk_block=60, query_block=6)
    assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == _brute(rows, qs, 7)


def test_search_smaller_k_is_a_prefix(vectors):
    _, _, chunks, queries = vectors
    a = {(r.query_id, r.chunk_id) for r in retrieve.search(queries, chunks, 4).collect()}
    b = {(r.query_id, r.chunk_id) for r in retrieve.search(queries, chunks, 5).where("rank <= 4").collect()}
    assert a == b


def test_search_ignores_missing_and_odd_vectors(spark):
    chunks = spark.createDataFrame(
        [(1, "r", [1.0, 0.0]), (2, "r", None), (3, "r", []), (4, "r", [1.0]), (5, "other", [1.0, 0.0])],
        "chunk_id bigint, repo string, vector array<float>",
    )
    queries = spark.createDataFrame([(9, "r", [1.0, 0.0])], "query_id bigint, repo string, vector array<float>")
    for few in (True, False):
        assert [r.chunk_id for r in retrieve.search(queries, chunks, 3, few).collect()] == [1]


def test_few_looks_at_rows_and_width(vectors):
    _, _, _, queries = vectors
    assert retrieve.few(queries)
    assert not retrieve.few(queries, max_rows=39)
    assert not retrieve.few(queries, max_floats=319)


def test_embed_blank_and_failed_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "bad one")], "id int, text string").coalesce(1)
    rows = {r.id: r for r in embed.embed(df, partial(embed.HashEmbedder, 4, "bad"), batch_size=1).collect()}
    assert len(rows[1].vector) == 4 and abs(sum(x * x for x in rows[1].vector) - 1) < 1e-5
    assert rows[2].vector == [0.0] * 4 and rows[3].vector == [0.0] * 4
    assert rows[4].vector == [] and "refused" in rows[4].error


def test_modal_dim_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame(
        [("r", 1, [1.0]), ("r", 2, [1.0, 2.0]), ("r", 3, [1.0, 2.0]), ("r", 4, [1.0]), ("x", 5, None)],
        "repo string, chunk_id bigint, vector array<float>",
    )
    assert {r.chunk_id for r in embed.keep_modal_dim(df).collect()} == {1, 4}
    assert [r.repo for r in embed.repos_without_vectors(df).collect()] == ["x"]


def test_copies_are_embedded_once(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(90)], "chunk_id bigint, text string")
    store = spark.createDataFrame([], "text_hash string, vector array<float>, model string")
    new = embed.embed_missing(df, store, "m", partial(embed.HashEmbedder, 4))
    assert new.count() == 31
    full = embed.attach_vectors(df, new, "m")
    assert full.where("vector IS NULL").count() == 0 and full.count() == 90
    again = embed.missing_texts(df, cut_lineage(new), "m")
    assert again.count() == 0


def test_key_filter_keeps_every_key_and_few_others(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    keys = cut_lineage(df.where("k % 100 = 7").select("k"))
    got = embed.maybe_among(df, "k", keys)
    kept = {r.k for r in got.collect()}
    assert got.columns == ["k", "t"] and {r.k for r in keys.collect()} <= kept and len(kept) < 300
    assert embed.maybe_among(df, "k", keys, bits=32_768).count() < 1_000
    assert embed.maybe_among(df, "k", keys, bits=64).count() == 20_000  # too many keys for the filter
    assert embed.maybe_among(df, "k", keys.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_index_moves_asked_vectors_only(spark):
    chunks = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)] + [(9, None)], "chunk_id bigint, text string")
    rows = [(f"t{i}", [float(i)]) for i in range(2)] + [("t1", [1.0])] + [(f"other{i}", [0.5]) for i in range(50)]
    store = spark.createDataFrame(rows, "t string, vector array<float>").select(
        embed.text_hash(F.col("t")).alias("text_hash"), F.lit("m").alias("model"), "vector"
    )
    hashed = chunks.withColumn("text_hash", embed.text_hash(F.col("text")))
    assert embed.stored_vectors(hashed, store, "m").count() == 2
    got = {r.chunk_id: r.vector for r in embed.attach_vectors(chunks, store, "m").collect()}
    assert got == {i: ([float(i % 3)] if i % 3 < 2 else None) for i in range(9)} | {9: None}
    assert embed.stored_vectors(hashed, store, "other").count() == 0
    assert {r.text for r in embed.missing_texts(chunks.where("text is not null"), store, "m").collect()} == {"t2"}


def test_token_counts_under_a_vocabulary(spark, tmp_path):
    import base64

    ranks = str(tmp_path / "own.tiktoken")
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b" ab"]
    with open(ranks, "wb") as f:
        f.write(b"\n".join(base64.b64encode(p) + b" " + str(i).encode() for i, p in enumerate(pieces)))
    rows = [(1, "abc ab"), (2, "abcab"), (3, ""), (4, None), (5, "stop <|endoftext|> here"), (6, "\u00e9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.token_count, r.counted_by) for r in corpus.count_tokens(docs, ranks, r" ?\w+|\s+|.").collect()}
    assert got == {1: (2, "vocabulary"), 2: (2, "vocabulary"), 3: (0, "vocabulary"), 4: (None, None), 5: (5, "length"), 6: (2, "vocabulary")}
    for path in (None, str(tmp_path / "missing")):
        by_length = corpus.count_tokens(docs, path, "").collect()
        assert [(r.token_count, r.counted_by) for r in by_length[:2]] == [(1, "length"), (1, "length")]


def test_vocabulary_counts_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = corpus.count_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    whole = tok.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert rows and all(r.counted_by == "vocabulary" and r.token_count == len(e.ids) for r, e in zip(rows, whole, strict=True))


def test_join_text_names_what_does_not_fit(spark):
    parts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z" * 50)], "k string, pos int, t string")
    got = {r.k: (r.n_chars, r.text, r.error) for r in join_text(parts, ["k"], ["pos"], "t", sep="-", max_chars=10).collect()}
    assert got == {"a": (3, "x-y", None), "b": (50, None, "a text of 50 characters does not fit one cell")}


@pytest.mark.parametrize("size", [1, 7, 60, 10_000])
def test_text_blocks_hold_every_text(spark, size):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, None if i % 11 == 0 else str(i)) for i in range(600)] + [("e", 0, "")]
    parts = spark.createDataFrame(rows, "k string, pos int, t string").repartition(5)
    blocks = text_blocks(parts, ["k"], ["pos"], "t", sep=", ", block_chars=size).collect()
    got = {}
    for b in sorted(blocks, key=lambda b: (b.k, b.block)):
        got[b.k] = got.get(b.k, "") + b.text
    want = {k: ", ".join(t for g, _, t in rows if g == k and t is not None) for k in {r[0] for r in rows}}
    assert got == want
    for k in want:
        assert sorted(b.block for b in blocks if b.k == k) == list(range(sum(b.k == k for b in blocks)))


def whole(df, key, text):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r.block)):
        out[r[key]] = out.get(r[key], "") + r[text]
    return out


SMALL = {"cell_chars": 30, "block_chars": 25}


def test_prompts_of_any_length_equal_their_short_form(spark):
    talk = [(c, t, ("user", "assistant")[t % 2], f"says {c}-{t}") for c in (1, 2) for t in range(2 if c == 1 else 40)] + [(3, 0, "user", "alone")]
    pairs = converse.pair_turns(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, content string"))
    want = {r.conv_id: r.history for r in converse.render_history(pairs).collect()}
    assert whole(converse.history_blocks(pairs, **SMALL), "conv_id", "history") == want
    assert len(converse.history_blocks(pairs, **SMALL).where("conv_id = 2").collect()) == 20
    numbered = whole(converse.numbered_history(pairs), "conv_id", "history")
    assert whole(converse.numbered_history(pairs, **SMALL), "conv_id", "history") == numbered and "1.\nUser: " in numbered[2]
    rows = [(1, "sys", "a.py", "code", "what", "ollama", "ctx"), (2, "sys", "a.py", "", "why", "x", " "), (3, "s", None, None, "q", "x", None)]
    asked = spark.createDataFrame(rows, "conv_id bigint, system_prompt string, file_path string, file_content string, query string, provider string, context string")
    c = F.col
    cells = asked.join(spark.createDataFrame(list(want.items()) or None, "conv_id bigint, history string"), "conv_id", "left")
    parts = (c("system_prompt"), c("history"), c("file_path"), c("file_content"))
    full = cells.select("conv_id", converse.full_prompt(*parts, c("context"), c("query"), c("provider")).alias("p"))
    plain = cells.select("conv_id", converse.simplified_prompt(*parts, c("query"), c("provider")).alias("p"))
    for options in ({}, SMALL):
        got = converse.prompt_blocks(asked, pairs, converse.context_block(c("context")), **options)
        assert whole(got, "conv_id", "prompt") == {r.conv_id: r.p for r in full.collect()}
        got = converse.prompt_blocks(asked, pairs, F.lit(converse.SIMPLIFIED), **options)
        assert whole(got, "conv_id", "prompt") == {r.conv_id: r.p for r in plain.collect()}


def test_long_trees_answers_and_decks_are_blocks(spark):
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    listing = spark.createDataFrame([("a", f"f{i:03d}.py") for i in range(50)] + [("a", "f001.py"), ("x", "other")], "repo string, file_path string")
    readmes = spark.createDataFrame([("a", "read me")], "repo string, readme string")
    want = {r.repo: r.prompt for r in converse.structure_prompt(repos, listing, readmes).collect()}
    for options in ({}, SMALL):
        assert whole(converse.structure_prompt_blocks(repos, listing, readmes, **options), "repo", "prompt") == want
    deltas = [(r, i, f"d{i} " if i % 3 else None, "id", "m", i, 5) for r in (1, 2) for i in range(3 if r == 1 else 60)]
    deltas = spark.createDataFrame(deltas, "response_id bigint, seq bigint, delta string, id string, model string, created bigint, total_tokens bigint")
    short, long = generate.fold_deltas(deltas), generate.fold_deltas(deltas, **SMALL)
    assert whole(short, "response_id", "content") == whole(long, "response_id", "content")
    assert long.count() > short.count() == 2 and {r.created for r in long.where("response_id = 2").collect()} == {59}
    slides = spark.createDataFrame([(1, k, f"<b>{k}</b>") for k in range(20)], "deck_id bigint, k bigint, html string")
    assert whole(exports.slide_decks(slides), "deck_id", "document") == whole(exports.slide_decks(slides, **SMALL), "deck_id", "document")


def test_a_tree_that_fits_no_cell_is_an_error(spark):
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    listing = spark.createDataFrame([("a", "x.py"), ("b", "y" * 50)], "repo string, file_path string")
    readmes = spark.createDataFrame([], "repo string, readme string")
    got = {r.repo: r for r in converse.structure_prompt(repos, listing, readmes, max_chars=10).collect()}
    assert "x.py" in got["a"].prompt and got["a"].tree_error is None
    assert got["b"].prompt is None and "does not fit" in got["b"].tree_error


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()  # the plan of this very frame becomes final
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def eager_to_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_texts_and_conversations_are_split(spark, eager_to_split):
    n = 20_000
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    ids = spark.range(0, n, 1, 8)
    chunks = ids.select(F.col("id").alias("chunk_id"), F.concat(F.lit("text "), key.cast("string")).alias("text"))
    store = chunks.select(embed.text_hash(F.col("text")).alias("text_hash"), F.array(F.lit(1.0).cast("float")).alias("vector"),
                          F.lit("m").alias("model"))
    rows, plan = _final_plan(embed.attach_vectors(chunks, store, "m"))
    assert len(rows) == n and all(r.vector for r in rows) and "skew=true" in plan
    messages = ids.select(key.alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                          F.concat(F.lit("[DEEP RESEARCH] "), F.col("id").cast("string")).alias("content"))
    rows, plan = _final_plan(converse.strip_tags(messages, converse.request_state(messages)))
    assert len(rows) == n and "skew=true" in plan


@pytest.mark.parametrize("few", [True, False])
def test_pruned_search_equals_the_whole_and_reads_less(spark, few):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    vec = [[float(x) for x in centres[i % 40] + 0.02 * rng.standard_normal(16)] for i in range(2000)]
    rows = [(i, "hot" if i % 3 else f"r{i % 5}", v) for i, v in enumerate(vec)]
    rows += [(5000 + i, "hot", vec[i % 4]) for i in range(30)]  # ties
    rows += [(6000, "hot", []), (6001, "hot", None), (6002, None, vec[0]), (6003, "hot", [1.0, 2.0])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, repo string, vector array<double>")
    qs = [(i, ["hot", "r0", "r3"][i % 3], vec[i * 7]) for i in range(30)] + [(90, "none", vec[0]), (91, None, vec[0]), (92, "hot", []), (93, "hot", [0.5, 1.0])]
    queries = spark.createDataFrame(qs, "query_id bigint, repo string, vector array<double>")
    marked = cut_lineage(blocks.mark_blocks(chunks))
    stats = blocks.block_stats(marked)
    want = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in retrieve.search(queries, chunks, 10).collect()}
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in blocks.search_pruned(queries, marked, stats, 10, broadcast_queries=few).collect()}
    assert got == want and len(want) == 301
    bound = cut_lineage(blocks.first_blocks(blocks.bounds(queries, stats), 10))
    found = blocks._search_in(queries, marked, bound.where("first"), 10)
    read = bound.where("first").count() + blocks.open_blocks(bound, found, 10).count()
    assert read < bound.count() / 2
    assert blocks.search_pruned(queries, marked.limit(0), stats.limit(0), 10).count() == 0


def test_search_reads_the_partitions_asked_for(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(i, f"r{i % 4}", "f", f"t{i}", [float(i % 7), 1.0]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, repo string, file_path string, text string, vector array<double>")
    stores.write_chunks(chunks, path)
    stored = stores.read_chunks(spark, path, "chunk_id bigint, file_path string, text string, vector array<double>, repo string")
    queries = spark.createDataFrame([(1, "r1", [1.0, 0.0]), (2, None, [1.0, 0.0])], "query_id bigint, repo string, vector array<double>")
    asked = retrieve.only_asked(queries, stored, True)
    assert "PartitionFilters: [isnotnull(repo" in (plan := asked._jdf.queryExecution().executedPlan().toString()), plan
    got = {r.chunk_id for r in flagship.hits(queries, stored, 3).collect()}
    want = {r[0] for r in sorted((r for r in rows if r[1] == "r1"), key=lambda r: (-r[4][0], r[0]))[:3]}
    assert got == want
    assert retrieve.only_asked(queries, stored, False).count() == 10
    assert retrieve.only_asked(queries.limit(0), stored, True).count() == 0


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")


def test_pairing_is_by_position(spark):
    m = _messages(spark, [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
                          (2, 0, "user", "u"), (2, 1, "assistant", "a"), (2, 2, "user", "v")])
    assert [(r.conv_id, r.user_text, r.assistant_text) for r in converse.pair_turns(m).collect()] == [(2, "u", "a")]


def test_request_state_recovers_the_topic(spark):
    m = _messages(spark, [(1, 0, "user", "[DEEP RESEARCH] Cats"), (1, 1, "assistant", "plan"),
                          (1, 2, "user", "[DEEP RESEARCH] Continue the research"), (2, 0, "user", "hi"),
                          (3, 0, "user", "x"), (3, 1, "assistant", "y")])
    s = {r.conv_id: r for r in converse.request_state(m).collect()}
    assert (s[1].query, s[1].iteration, s[1].phase) == ("Cats", 2, "intermediate")
    assert (s[2].query, s[2].iteration, s[2].phase, s[2].error_code) == ("hi", 1, "simple", None)
    assert s[3].error_code == 400


def test_intermediate_template_shows_a_literal_mark(spark):
    p = converse.system_prompt(F.lit("intermediate"), F.lit("github"), F.lit("u/r"), F.lit("English"), F.lit(3))
    assert "iteration 3" in (got := spark.range(1).select(p.alias("p")).first().p) and "{research_iteration}" in got


def test_redrive_only_token_limit_errors(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "far too many words here"), (3, "boom")], "id int, prompt string")
    make = partial(generate.EchoGenerator, 3, "boom")
    out = generate.redrive(cut_lineage(generate.generate(df, make)), F.lit("short"), make)
    rows = {r.id: (r.attempt, r.response, r.error) for r in out.collect()}
    assert rows == {1: (1, "echo: ok", None), 2: (2, "echo: short", None), 3: (1, None, "model unavailable")}


def test_payload_chat_roles(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")),
                F.struct(F.lit("tool").alias("role"), F.lit("r").alias("content")))
    got = spark.range(1).select(generate.payload(F.lit("anthropic"), F.lit("p"), m).alias("x")).first().x
    assert '"role":"assistant","content":[{"type":"text","text":"r"}]' in got


def test_response_text_falls_through(spark):
    def at(family, raw):
        return spark.range(1).select(generate.response_text(F.lit(family), F.lit(raw)).alias("x")).first().x

    assert at("meta", '{"completion":"c"}') == "c"
    assert at("meta", '{"none":1}') == '{"none":1}'
    assert at("anthropic", '{"content":[]}') == ""
    assert at("openai", '{"choices":[{"text":"t"}]}') == "t"


def test_contents_decode_error_kinds(spark):
    rows = [("github", '{"content":"/w==","encoding":"base64"}', None, "undecodable content"),
            ("github", "{}", None, "file content not found"),
            ("gitlab", '{"message": no json', '{"message": no json', None),
            ("github", '{"content":"aGkK\\nYQ==","encoding":"base64"}', "hi\na", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, provider string, body string, t string, e string")
    for r in corpus.decode_contents(df).collect():
        assert (r.text, r.error) == (r.t, r.e)


def test_section_tree_survives_cycles_and_shared_children(spark):
    s = spark.createDataFrame(
        [("w", "a", 1, ["b", "c"]), ("w", "b", 2, ["d", "gone"]), ("w", "c", 3, ["d"]), ("w", "d", 4, ["b"])],
        "wiki_id string, section_id string, pos bigint, child_ids array<string>",
    )
    got = {"/".join(r.path) for r in wiki.section_tree(s, wiki.root_sections(s)).collect()}
    assert got == {"a", "a/b", "a/c", "a/b/d", "a/c/d", "a/c/d/b"}


def _outline_by_hand(sections, pages, roots):
    """Least deep places by breadth, then one walk in display order."""
    place, frontier = {r: None for r in roots}, list(roots)
    while frontier:
        links = sorted((sections[p][0], p, k, c) for p in frontier for k, c in enumerate(sections[p][2]) if c in sections)
        frontier = []
        for _, p, k, c in links:
            if c not in place:
                place[c] = (p, k)
                frontier.append(c)
    out = []

    def walk(s, parent, depth):
        at = len(out)
        out.append(None)
        for p in sections[s][1]:
            if p in pages:
                out.append((len(out), len(out), "page", p, s, depth + 1))
        for k, c in enumerate(sections[s][2]):
            if c in sections and place.get(c) == (s, k):
                walk(c, s, depth + 1)
            elif c in sections:
                out.append((len(out), len(out), "reference", c, s, depth + 1))
        out[at] = (at, len(out) - 1, "section", s, parent, depth)

    for r in sorted(roots, key=lambda r: sections[r][0]):
        walk(r, None, 0)
    return sorted(out)


def test_outline_of_dense_and_cyclic_plans(spark):
    names = [f"s{i}" for i in range(30)]
    dense = {n: (i, [f"p{i}", "gone"], names[i + 1:]) for i, n in enumerate(names)}  # 2**28 paths
    cyclic = {"a": (1, ["p1", "p2"], ["b", "c", "b"]), "b": (2, ["p1"], ["d", "gone"]), "c": (3, [], ["d", "a"]), "d": (4, ["p2", "p1"], ["b"]), "e": (0, [], [])}
    pages = {f"p{i}" for i in range(30)}
    rows = [(w, s, *v) for w, plan in (("dense", dense), ("cyclic", cyclic)) for s, v in plan.items()]
    s = spark.createDataFrame(rows, "wiki_id string, section_id string, pos bigint, page_ids array<string>, child_ids array<string>")
    p = spark.createDataFrame([(w, x) for w in ("dense", "cyclic") for x in pages], "wiki_id string, id string")
    roots = s.where("section_id IN ('s0', 'a', 'e')")
    start = time.time()
    got = wiki.section_outline(s, p, roots).collect()
    assert time.time() - start < 120
    for name, plan, at in (("dense", dense, ["s0"]), ("cyclic", cyclic, ["a", "e"])):
        found = sorted((r.entry, r.exit, r.kind, r.id, r.parent_id, r.depth) for r in got if r.wiki_id == name)
        assert found == _outline_by_hand(plan, pages, at)
    chain = s.where("wiki_id = 'dense'").withColumn("child_ids", F.slice("child_ids", 1, 1))
    cut = wiki.section_outline(chain, p, roots, max_depth=3).orderBy("entry").collect()
    assert [r.kind for r in cut] == ["section", "page"] * 4 + ["error"] and cut[-1].error == "nested deeper than 3 levels"
    assert cut[0].exit == 8 and wiki.section_outline(s.limit(0), p, roots.limit(0)).count() == 0


def test_substring_categories(spark):
    df = spark.createDataFrame([("Container",), ("User guide",), ("Nothing",)], "title string")
    assert [r.c for r in df.select(wiki.title_category(F.col("title")).alias("c")).collect()] == ["models", "ui", "other"]


def _pack_by_hand(pages, budget):
    out, total = [], 0
    for pos, title, imp, content in pages:
        if imp == "high" and content:
            t = f"## {title}\n{content}\n\n"
            out.append((1, pos, "full"))
            total += len(t)
            if total > budget:
                break
    if total < budget:
        for pos, title, imp, content in pages:
            if imp == "high" or not content:
                continue
            full = len(f"## {title}\n{content}\n\n")
            short = len(f"## {title}\nNo summary available\n\n")
            fits = total + full <= budget
            out.append((2, pos, "full" if fits else "summary"))
            total += full if fits else short
            if total > budget:
                break
    return out


def test_unreachable_blocks_are_dropped_exactly(spark):
    rows = [("w", i * 3, 10 + i % 5) for i in range(200)] + [("v", 5, 1)]
    df = spark.createDataFrame(rows, "wiki_id string, pos bigint, full int")
    kept = {(r.wiki_id, r.pos) for r in derive._reachable(df, F.col("full"), 300, block=32).collect()}
    total, needed = 0, set()
    for w, p, n in rows[:200]:
        if total > 300:
            break
        needed.add((w, p))
        total += n
    assert needed <= kept and len(kept) < 60 and ("v", 5) in kept


@pytest.mark.parametrize("seed", range(4))
def test_pack_equals_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    pages = [(i, f"t{i}", ["high", "medium", "low"][rng.integers(3)], "x" * int(rng.integers(0, 120))) for i in range(60)]
    df = spark.createDataFrame([("w", *p) for p in pages], "wiki_id string, pos bigint, title string, importance string, content string")
    for budget in (300, 900, 5000):
        got = sorted((r.phase, r.pos, r.used) for r in derive.pack(df, budget).collect())
        assert got == _pack_by_hand(pages, budget)


def test_workshop_steps(spark):
    text = "```markdown\n# W\n\nIntro\n\n## Exercise 1: A\nx\n## Exercise 2: B\ny\n## Final Project\nz\n```"
    got = spark.createDataFrame([(text,)], "c string").select(derive.workshop(F.col("c")).alias("c")).first().c
    assert got.startswith("# W\n\nIntro\n\n## Table of Contents\n\n- [Exercise 1: A](#exercise-1-a)\n")
    assert "Exercise 2 of 2 | Estimated time: 15 minutes" in got and "20-30 minutes" in got
    assert got.index("## Final Project\n<div") > 0 and not got.endswith("```")


def test_slide_patterns(spark):
    df = spark.createDataFrame([("1. A: b\n2. C",), ("1) A\n2) B",), ("Slide 1: A\nSlide 2: B",), ("please read\nBig Title: d",), ("",)], "p string")
    got = [r.x for r in df.select(derive.slide_items(F.col("p"), F.lit("R")).alias("x")).collect()]
    assert got[:4] == [["A: b", "C"], ["A", "B"], ["A", "B"], ["Big Title"]]
    assert len(got[4]) == 7 and got[4][0] == "Title Slide: Introduction to R"


class FailsTwice:
    """Answers a prompt at its third call."""

    def __init__(self):
        self.calls = {}

    def __call__(self, prompt):
        self.calls[prompt] = self.calls.get(prompt, 0) + 1
        if self.calls[prompt] < 3:
            raise RuntimeError("busy")
        return generate.Reply(prompt.upper())


def test_failed_calls_are_made_again(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    again = generate.generate(df, FailsTwice, retries=2).collect()
    assert {(r.response, r.error) for r in again} == {("A", None), ("B", None)}
    once = generate.generate(df, FailsTwice, retries=1).collect()
    assert {(r.response, r.error) for r in once} == {(None, "busy")}


class Slow:
    """Takes 50 ms for a prompt and notes in a folder that it was called."""

    def __init__(self, folder=None, broken=""):
        self.folder, self.broken = folder, broken

    def __call__(self, prompt):
        time.sleep(0.05)
        if self.folder:
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
        if self.broken and self.broken in prompt:
            raise RuntimeError("down")
        return generate.Reply(f"re: {prompt}", 1, 2)


def test_calls_overlap_and_keep_their_order(spark):
    prompts = spark.range(0, 1000, 1, 1).selectExpr("id", "concat('p', id) as prompt")
    start = time.time()
    rows = generate.generate(prompts, Slow, in_flight=16).collect()
    assert time.time() - start < 6
    assert [(r.id, r.response) for r in rows] == [(i, f"re: p{i}") for i in range(1000)]


def test_a_job_keeps_its_rate(spark):
    prompts = spark.range(0, 40, 1, 2).selectExpr("id", "concat('p', id) as prompt")
    start = time.time()
    rows = generate.generate(prompts, Slow, parallel=2, in_flight=8, calls_per_second=20).collect()
    assert len(rows) == 40 and time.time() - start >= 40 / 20 - 0.3
    with pytest.raises(ValueError, match="share"):
        generate.generate(prompts, Slow, calls_per_second=20)


def test_prompts_are_answered_once(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    prompts = spark.createDataFrame([(i, f"p{i % 6}") for i in range(30)] + [(99, None)], "id bigint, prompt string")
    make = partial(Slow, str(calls), "p5")
    first = {r.id: (r.response, r.error) for r in generate.generate_once(prompts, make, store, waves=3, in_flight=4).collect()}
    assert first[4] == ("re: p4", None) and first[5] == (None, "down") and first[99] == (None, "empty prompt") and len(first) == 31
    assert len(list(calls.iterdir())) == 6
    again = generate.generate_once(prompts, partial(Slow, str(calls)), store, waves=3).collect()
    assert len(list(calls.iterdir())) == 7 and {r.response for r in again if r.id % 6 == 5 and r.id < 30} == {"re: p5"}


def _store(spark, tmp_path, chunks, **kw):
    return packs.write_packs(chunks, f"packs_{uuid.uuid4().hex}", str(tmp_path / "packs"), 4, **kw)


def test_packed_search_equals_brute_force(spark, vectors, tmp_path):
    rows, qs, chunks, queries = vectors
    stored = _store(spark, tmp_path, chunks.repartition(5), cell=60, pack=8)
    assert stored.where("repo = 'hot'").select("cell").distinct().count() == 12
    for held in (20_000, 3):
        got = packs.search(queries, stored, 7, query_pack=6, held=held)
        assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == _brute(rows, qs, 7)


def test_packed_search_of_odd_rows(spark, tmp_path):
    v, w = [1.0, 2.0], [1.0, 0.0, 3.0]
    rows = [(1, "a", v), (1, "a", v), (2, "a", w), (3, "a", []), (4, "a", None), (5, None, v), (None, "a", v), (6, "b", v)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, repo string, vector array<float>").withColumn("cell", F.lit("mine"))
    qs = [(1, "a", v), (2, "a", w), (3, "a", None), (4, None, v), (5, "none", v), (6, "b", w)]
    queries = spark.createDataFrame(qs, "query_id bigint, repo string, vector array<float>").withColumn("packs", F.lit(9))
    stored = _store(spark, tmp_path, chunks)
    got = [(r.query_id, r.chunk_id, r.score, r.rank) for r in packs.search(queries, stored, 5).collect()]
    assert sorted(got) == [(1, 1, 5.0, 1), (1, 1, 5.0, 2), (2, 2, 10.0, 1)]
    assert packs.search(queries.limit(0), stored).count() == 0
    none = packs.write_packs(chunks.limit(0), f"packs_{uuid.uuid4().hex}", str(tmp_path / "none"), 2)
    assert packs.search(queries, none).count() == 0


def _moved(df):
    """Names of the columns that each shuffle of the plan moves."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_stored_vectors_and_texts_are_not_shuffled(spark, vectors, tmp_path):
    _, _, chunks, queries = vectors
    texts = chunks.select("chunk_id", F.lit("p").alias("file_path"), F.col("repo").alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = packs.pairs_of_packs(cut_lineage(queries), _store(spark, tmp_path, chunks, cell=60, pack=8))
        plan, moves = _moved(pairs)
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        asked = [m for m in moves if "cell#" in m]
        assert len(asked) == 1 and plan.index("Scan parquet") < min(map(plan.index, moves))  # the queries' side alone
        name = f"texts_{uuid.uuid4().hex}"
        colocated.write(texts, name, str(tmp_path / "texts"), ["chunk_id"], 4)
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
        stored = colocated.attach(spark, name, str(tmp_path / "texts"), ["chunk_id"], 4)
        hits = cut_lineage(retrieve.search(queries, chunks, 3))
        full = retrieve.hydrate(hits, stored)
        plan, moves = _moved(full)
        assert "Bucketed: true" in plan and len(moves) == 1 and "Scan ExistingRDD" in plan[plan.index(moves[0]):]
        want = {(r.query_id, r.rank, r.text) for r in retrieve.hydrate(hits, texts).collect()}
        assert {(r.query_id, r.rank, r.text) for r in full.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


class _Flaky(embed.HashEmbedder):
    """Fails the first ``n`` calls of a task; with ``short`` it answers one vector too few instead."""

    def __init__(self, n, short=False):
        super().__init__(4)
        self.n, self.short = n, short

    def __call__(self, texts):
        self.n -= 1
        if self.n >= 0 and not self.short:
            raise RuntimeError("")
        return super().__call__(texts)[: -1 if self.n >= 0 else None]


@pytest.mark.parametrize("short", [False, True])
def test_failed_batches_are_sent_again(spark, short):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id bigint, text string").coalesce(1)
    rows = embed.embed(docs, partial(_Flaky, 2, short), batch_size=2, retries=1).orderBy("id").collect()
    why = "1 vectors for 2 texts" if short else "RuntimeError"
    assert [r.error for r in rows] == [why, why, None, None, None]
    assert [len(r.vector) for r in rows] == [0, 0, 4, 4, 4]
    rows = embed.embed(docs, partial(_Flaky, 2, short), batch_size=2, retries=2).orderBy("id").collect()
    want = embed.embed(docs, partial(embed.HashEmbedder, 4)).orderBy("id").collect()
    assert [r.vector for r in rows] == [r.vector for r in want] and not any(r.error for r in rows)


def test_a_list_is_one_batch(spark):
    lists = [(1, ["a", None, " ", "b"]), (2, ["a", "bad", ""]), (3, []), (4, None), (5, [""])]
    df = spark.createDataFrame(lists, "id bigint, texts array<string>").repartition(3)
    rows = {r.id: r for r in embed.embed_lists(df, partial(embed.HashEmbedder, 4, "bad")).collect()}
    assert {i: None if r.vectors is None else [len(v) for v in r.vectors] for i, r in rows.items()} == {
        1: [4, 4, 4, 4], 2: [0, 0, 4], 3: [], 4: None, 5: [4]
    }
    a, b = (embed.HashEmbedder(4)([x])[0] for x in "ab")
    assert rows[1].vectors[0] == pytest.approx(a) and rows[1].vectors[3] == pytest.approx(b)
    assert [i for i, r in rows.items() if r.error] == [2]
