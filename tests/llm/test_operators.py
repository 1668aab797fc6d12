"""Each operator against a brute-force version on small tables with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repolore.llm import bpe, chat, decontaminate, jaccard_join, line_dedup, mixing, quality_rules, substring_dedup, token_counts, token_shards, url_rules
from repolore.llm.graph import components
from repolore.session import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, size string, pos string"


def docs(spark, texts, sources=None):
    """Documents with columns whose names clash with those inside the operators; the last row's id is null."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t), "x", None, "y") for i, t in enumerate(texts)]
    rows.append((None, "no id", None, None, 5, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ÉCOLE", "x\u00a0y"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 120))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(0, n, 4):
        texts[i] = texts[i] + " " + passage + "\nline one\nline two\nline three\n" + str(i)
    texts[3] = texts[1]
    texts[5] = " ".join(WORD.findall(texts[2])[:-1] + ["changed"])
    return [*texts, None, "", " \n\t ", "short", "a a a a a a a a a a a a", "z" * 50_000, "deep " * 9_000]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (900, 900)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_counts_equal_encoding_each_prefix():
    vocab, tok = bpe.vocabulary(JSON), Tokenizer.from_file(JSON)
    count = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    parts = ["'s", "'re", "'", "a", "the", "ing", " ", "  ", "\n\n", "\t", "!!", "12", "é", "中", "😀", "\xa0", "　", "..."]
    rnd = random.Random(2)
    for _ in range(400):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))
        steps = vocab.text_steps(s)
        assert [token_counts.tokens_at(steps, i) for i in range(len(s) + 1)] == [count(s[:i]) for i in range(len(s) + 1)], s
    assert len(vocab.text_steps("a<|endoftext|> b")) == 16 and token_counts.tokens_at(vocab.text_steps("a<|endoftext|> b"), 16) == count("a<|endoftext|> b")


def test_token_counts(spark):
    tok, texts = Tokenizer.from_file(JSON), corpus()
    rows = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), JSON, 50).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 50)
        assert len(tok.encode((t or "")[: rows[i].kept_chars], add_special_tokens=False).ids) <= 50
    table = {r.doc_id: r.steps for r in token_counts.prefix_table(docs(spark, texts), JSON).collect()}
    cuts = token_counts.budget_cuts(bytes(table[0]), 20)
    assert cuts[-1] == len(texts[0]) and cuts == sorted(set(cuts)) and token_counts.budget_cuts(b"", 5) == []


def test_line_dedup(spark):
    texts = corpus()
    wins = defaultdict(list)
    for i, t in enumerate(texts):
        x = t.split("\n") if t else []
        for p in range(len(x) - 2):
            if any(WORD.search(y) for y in x[p : p + 3]):
                wins[tuple(x[p : p + 3])].append((i, p))
    gone = {(i, p + k) for places in wins.values() for i, p in sorted(places)[1:] for k in range(3)}
    rows = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs(spark, texts)).collect()}
    assert len(rows) == len(texts) + 1 and any(r.n_removed for r in rows.values())
    for i, t in enumerate(texts):
        x = t.split("\n") if t else []
        kept = [y for k, y in enumerate(x) if (i, k) not in gone]
        assert (rows[i].n_lines, rows[i].n_removed, rows[i].kept_text) == (len(x), len(x) - len(kept), "\n".join(kept))


def test_permutation_and_shards(spark):
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(token_shards.permute(np.arange(n), n, 9)) == list(range(n))
    texts = corpus()
    layout = token_shards.write_shards(docs(spark, texts), scratch_dir(spark, "t"), RANKS, length=16, shard_bytes=4_000)
    enc, got = token_shards.ids(RANKS), defaultdict(list)
    seqs = token_shards.read_sequences(spark, layout).collect()
    assert sorted(r.slot for r in seqs) == list(range(layout["total"])) and layout["shards"] > 1
    for r in seqs:
        got[r.doc_id].append((r.seq, r.ids))
    for i, t in enumerate([*texts, "no id"]):
        key = i if i < len(texts) else None
        assert [x for _, s in sorted(got[key]) for x in s] == [*enc.ranks(t or ""), enc.end]
    heads = token_shards.read_shards(spark, layout).collect()
    assert all(r.shard == r.slot // layout["per_shard"] and r.byte_offset == r.slot % layout["per_shard"] * layout["stride"] for r in heads)


def test_substring_dedup(spark):
    texts = corpus()
    seen = Counter(tuple(w[k : k + 35]) for t in texts for w in [WORD.findall(t or "")] for k in range(len(w) - 34))
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert len(rows) == len(texts) + 1 and sum(r.n_removed for r in rows.values()) > 500
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        hit = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                hit[k : k + 35] = [True] * 35
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_text) == (len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h))


def test_quality_statistics_and_rules(spark):
    texts = corpus()
    rows = {r.doc_id: r for r in quality_rules.statistics(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit))
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == want
    rnd = random.Random(4)
    good = [" ".join(f"{rnd.choice('abcde')}{j}" for j in range(40)) for _ in range(200)]
    mixed = docs(spark, [g if i % 4 else g.replace(" ", "## ") for i, g in enumerate(good)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 3)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(mixed, labels).select("doc_id", "kept").collect()}
    assert np.mean([kept[i] == (i % 4 > 0) for i in range(200) if i % 3]) == 1.0  # held out
    assert quality_rules.learn(mixed, labels.limit(0)) == []


@pytest.mark.parametrize("shard_words", [4_000_000, 300])
def test_source_mix(spark, shard_words):
    rnd = random.Random(6)
    texts = [" ".join("w" for _ in range(rnd.randint(0, 300))) + f" {i}" for i in range(90)] + [None, ""]
    sources = ["hot" if i % 3 else rnd.choice(["a", "b", None]) for i in range(92)]
    rows = mixing.mix(docs(spark, texts, sources), block=16, shard_words=shard_words).collect()
    again = mixing.mix(docs(spark, texts, sources).repartition(7), block=16, shard_words=shard_words).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in again)
    size, taken = Counter(), Counter()
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert len(rows) == 93
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, goal, free = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), {}, set(order)
    while True:
        unit = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / unit > 2 * size[s]]
        if not over:
            goal |= {s: left * weight[s] / unit for s in free}
            break
        for s in over:
            goal[s] = 2 * size[s]
        left -= sum(goal[s] for s in over)
        free -= set(over)
    for r in rows:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source]
    for s in order:
        assert abs(taken[s] - goal[s]) <= 16 + 0.03 * goal[s]


def test_mix_rows_hold_the_taken_words(spark):
    texts = [" ".join(f"w{i}_{k}" for k in range(30 + i)) for i in range(20)]
    table = docs(spark, texts)
    mixed = mixing.mix(table, block=8)
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got = Counter()
    for r in mixing.taken_rows(table, mixed).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert all(got[i] == want[i] for i in want)


def test_decontaminate(spark):
    items = [(1, "Anna bought 12 kg of red apples at the old market and gave 3 apples to her brother."), (2, "tiny item"), (3, None), (4, "12 15 19"), (None, "no id")]
    texts = [
        "intro words here. Then Anna bought 12 kg of red apples at the old market and gave 3 apples to her brother. End.",
        "now Peter bought 77 kg of red apples at the old market and gave 5 apples to her brother",
        "x",
        "nothing of the kind is in this text about apples",
        "it is a tiny item indeed",
        "12 15 20",
        "12 15 19",
        None,
        "",
    ]
    found = decontaminate.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(0, 1), (1, 1), (4, 2), (6, 4)]
    twice = [(1, "we saw Anna walk and then we saw Anna run and later we heard Anna sing")]
    texts = ["so we saw Lena walk and then we saw Lena run and later we heard Lena sing", "so we saw Lena walk and then we saw Mary run and later we heard Vera sing"]
    found = decontaminate.leaks(docs(spark, texts), spark.createDataFrame(twice, "item_id long, text string"))
    assert [r.doc_id for r in found.collect()] == [0]
    assert decontaminate.leaks(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_chat_windows(spark):
    rnd = random.Random(8)
    turns = [(c, t, "system" if not t and c % 2 else ("user", "assistant")[t % 2], " ".join(["tok"] * rnd.randint(0, 60))) for c in range(6) for t in range(rnd.randint(1, 25))]
    turns += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok\\l\\"), (50, 0, None, None), (50, 0, "assistant", ""), (None, 1, "a>b", "<turn x>\n")]
    table = spark.createDataFrame([(*r, 1) for r in turns], "conv_id long, turn long, role string, text string, window_no int")
    formatted = chat.windows(table, JSON, budget=120, history=40)
    rows = formatted.collect()
    assert all(r.n_tokens <= 120 or r.n_new == 1 for r in rows) and len(rows) > len({r.conv_id for r in rows})
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t, role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(got) == set(by)
    for c, x in by.items():
        x.sort()
        all_turns = "".join(f"{r}\n{s}\n" for _, r, s in x)
        loss = "".join(s for _, r, s in x if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(x), hashlib.sha256(all_turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(r.text) for r in rows if r.conv_id == c)


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, jaccard_join.BLOCK), (5, 80, 2_500)])
def test_jaccard_join(spark, k, num, block):
    rnd = random.Random(1)
    base = [[f"b{j}_{i}" for i in range(120)] for j in range(2)]
    texts = corpus()[:-2]
    for i in range(50):
        w = list(base[i % 2])
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(["x", "Y", "z"])
        texts.append(" ".join(w))
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(40)]
    sets, parent = {}, {}
    for i, t in enumerate([*texts]):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs(spark, texts), k, (num, 100), block).collect()}
    assert got.pop(None) == (1, None)
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_ranges_lose_no_pair():
    rnd = np.random.default_rng(3)
    for num in (80, 90):
        ranges, known = jaccard_join.Ranges(num, 100), {}
        for _ in range(300):
            n = int(rnd.integers(2, 400))
            most = n * (100 - num) // 100
            a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.r_[a[int(rnd.integers(0, most + 1)) :], rnd.integers(0, 1 << 63, int(rnd.integers(0, most + 1)), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if a.tobytes() == b.tobytes() or 100 * common < num * (len(a) + len(b) - common):
                continue
            x, y = (np.concatenate([*jaccard_join.parts(t, ranges, known), np.zeros(0, np.uint64)]) for t in (a, b))
            assert len(np.intersect1d(x, y))


def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b", "/", "allow"), ("b", "/xy", "block"), (None, "/", "block")]
    urls = ["http://X.example.org/es/1?q#z", "https://example.org/en/12", "https://notexample.org/en/1", "http://example.com/fr/", "ftp://a.b.com/de/x#y", "http://org", "http://org?x=/", "nothing", None, "", "x://h.a.b/xyz", "http://a.b/xyz", "http://EXAMPLE.org/EN/1", "http://a://b/c", "http://é.org/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h"), (None, "http://org/", "h")], "page_id long, url string, html string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 2 and sum(r.page_id == 0 for r in got) == 2
    for r in got:
        url = r.url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits) if fits else (0, 0, 0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[3], want[4]), url
    none = url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_empty_tables(spark):
    empty = docs(spark, []).limit(0)
    assert token_counts.token_counts(empty, JSON).count() == 0
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.similar_components(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert quality_rules.judge(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert token_shards.materialise(empty, RANKS).count() == 0
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), JSON)).count() == 0


def test_ids_of_short_and_very_long_texts_agree(monkeypatch):
    enc = token_shards.Ids(RANKS)
    texts = ["", " ", "a  b\n\nc's <|endoftext|> éü 123", "word " * 500]
    short = [(enc.of(x), enc.count(x)) for x in texts]
    monkeypatch.setattr(token_shards, "LONG", 0)
    assert [(enc.of(x), enc.count(x)) for x in texts] == short
    assert all(len(b) == 2 * n for b, n in short)


def test_chat_token_counts_agree_for_short_and_long_texts():
    vocab, encoder = bpe.vocabulary(JSON), Tokenizer.from_file(JSON)
    texts = ["", "a", "  two  spaces\n\n", "don't re-encode <|endoftext|> \\l é 漢字 🙂", "</turn>\n" * 40, "x" * 700]
    assert chat.count_tokens(texts, encoder, vocab) == chat.count_tokens(texts, encoder, vocab, long=0)
