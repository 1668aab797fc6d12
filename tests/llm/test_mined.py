"""Collocations, packing and spelling variants against brute-force versions, with nulls, long texts, ties, repeats and extra columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repolore.llm import collocations, packing, spelling

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, k int, phrase string, hash long, n long, word string, place long, path string"
LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark, texts, langs=None, parts=5):
    """Documents with columns whose names clash with those inside the operators; the last id is null."""
    rows = [(i if i + 1 < len(texts) else None, t, langs[i] if langs else "en", 1, "x", 2, 3, "y", None, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def phrases(texts, langs, min_count, longest, keep, absorb):
    f, n = defaultdict(Counter), Counter()
    for text, lang in zip(texts, langs, strict=True):
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            x = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(x)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(x[i : i + k]) for i in range(len(x) - k + 1))
    out = []
    for lang, c in f.items():
        rows = []
        long = [(p.split(" "), a) for p, a in c.items() if a >= min_count and " " in p]
        for x, a in long:
            inside = any(len(y) > len(x) and 100 * b >= absorb * a and any(y[i : i + len(x)] == x for i in range(len(y))) for y, b in long)
            if not inside:
                cuts = [(1000000 * a * a // (c[" ".join(x[:k])] * c[" ".join(x[k:])]), k, c[" ".join(x[:k])], c[" ".join(x[k:])]) for k in range(1, len(x))]
                score, _, le, ri = min(cuts)
                rows.append((-score, -a, " ".join(x).encode(), le, ri))
        out += [(lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(rows)[:keep])]
    return sorted(out)


def speech(seed, n, size):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(3000)] + ["New", "new", "YORK", "É", "x y", "\x1f"]
    ends = [" "] * 8 + [".", ", ", "\n", "\t", "  ", "\x0b", "?!"]
    return ["".join(rnd.choice(vocab) + rnd.choice(ends) for _ in range(rnd.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("longest,sample,bits,keep", [(3, 0.25, 26, 2000), (3, 0.0, 12, 40), (3, 1.0, 8, 7), (4, 0.1, 20, 2000)])
def test_collocations(spark, longest, sample, bits, keep):
    texts = [*speech(3, 120, 150), *["hot line of words here. hot line"] * 60, None, "", " \n.,\t", "z" * 30_000, "deep sea " * 4_000, "no id new york"]
    rnd = random.Random(1)
    langs = [rnd.choice(["en", "de", None, "und", ""]) for _ in texts]
    got = collocations.collocations(table(spark, texts, langs), min_count=10, longest=longest, keep=keep, sample=sample, bits=bits)
    assert sorted(map(tuple, got.collect())) == phrases(texts, langs, 10, longest, keep, 50)


def test_collocations_of_nothing_and_exact_products(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    rows = [("en", 1, "a", 10**13 + 7), ("en", 1, "b", 10**13 + 9), ("en", 2, "a b", 10**13 + 1), ("en", 0, "", 10**14)]
    out = collocations.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, a long")).collect()
    assert [r.score for r in out] == [1000000 * (10**13 + 1) ** 2 // ((10**13 + 7) * (10**13 + 9))]


def check_pieces(rows, texts, length):
    tok = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in enumerate(texts):
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i if i + 1 < len(texts) else None, len(x), zlib.crc32(x.tobytes()))] += 1
    ids = {(i if i + 1 < len(texts) else None): np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    covered, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        x = ids[r.doc_id][r.start : r.start + r.length]
        assert len(x) == r.length > 0 and zlib.crc32(x.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, x in ids.items():
        at = 0
        for start, n in sorted(covered[doc]):
            assert start == at
            at += n
        assert at == len(x)
    padding = used = 0
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        used += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding, used, len(fill), sum(len(c) - 1 for c in covered.values())


def test_packing(spark):
    texts = [*speech(5, 150, 400), None, "", "<|endoftext|> a<|endoftext|>", "z" * 50_000, "deep " * 9_000, " " * 3_000, "ééé 漢字 \U0001f600 ​" * 50, "no id"]
    for most_open in (4096, 6):
        rows = packing.pack(table(spark, texts), JSON, RANKS, length=256, most_open=most_open).collect()
        padding, used, sequences, _ = check_pieces(rows, texts, 256)
        assert padding == 0 and sequences <= used / 256 + 5 * 9
    assert packing.pack(table(spark, []), JSON, RANKS).count() == 0
    assert len(packing.pack(table(spark, ["same"] * 40), JSON, RANKS).collect()) >= 40


def test_levels_follow_the_sum_of_squares():
    rnd = random.Random(2)
    w, brute = packing.Windows(16, 10**9), Counter()
    for _ in range(4000):
        size = rnd.randint(1, 15)
        tries = []
        for fill in range(0, 17 - size):
            if fill and not brute[fill]:
                continue
            after = brute.copy()
            if fill:
                after[fill] -= 1
            if fill + size < 16:
                after[fill + size] += 1
            tries.append((sum(v * v for v in after.values()), -fill, after))
        brute = min(tries, key=lambda t: t[:2])[2]
        full = w.place((0, 0, size, np.zeros(size, "<u4")))
        assert full is None or sum(len(p[3]) for p in full) == 16
        assert {i: v for i, v in enumerate(w.levels) if v} == {k: v for k, v in brute.items() if v}
    assert w.n_open == sum(w.levels)


def test_a_crowd_of_windows_that_wait_is_closed():
    w, out = packing.Windows(16, 10), []
    for i in range(1000):
        assert w.place((i, 0, 9, np.arange(9, dtype="<u4"))) is None
        if w.crowded():
            out += w.close(last=False)
        assert w.n_open <= 10
    out += w.close(last=True)
    assert sum(len(p[3]) for s in out for p in s) == 9000 and all((n := sum(len(p[3]) for p in s)) == 16 or n & (n - 1) == 0 for s in out)


def spelled(texts, ids, min_chars=7, min_count=2, noise=31, ratio=10):
    c = Counter()
    for i, t in zip(ids, texts, strict=True):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    n = {w: k for w, k in c.items() if len(w) >= min_chars and k >= min_count}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(out, key=str)


def misspelt(seed=4):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abÀé") for _ in range(rnd.randint(6, 10))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "ÉCOLIERS"]
    weight = [10 ** rnd.randint(0, 3) for _ in base]
    out = []
    for i in range(120):
        xs = rnd.choices(base, weight, k=60)
        for j in range(len(xs)):
            if rnd.random() < 0.2:
                at, x = rnd.randrange(len(xs[j])), xs[j]
                xs[j] = rnd.choice([x[:at] + x[at + 1 :], x[:at] + "a" + x[at:], x[:at] + "b" + x[at + 1 :], x.upper()])
        out.append(rnd.choice([" ", "-", "1", "\n"]).join(xs) + (" longestword" if i % 2 else ""))
    return out


def test_spelling_variants(spark):
    long = "xy" * 20_000
    texts = [*misspelt(), None, "", " 12 \n", f"{long} {long} {long[:-1]} {long[:-1]} {long[:-1]}", "aaaaaaaa bbbbbbb", "bbbbbbb no id ééééééé ééééééé"]
    ids = [*range(len(texts) - 1), None]
    got = sorted((tuple(r) for r in spelling.variants(table(spark, texts)).collect()), key=str)
    want = spelled([t if t is None or len(t) < 10_000 else "" for t in texts], ids)
    assert [r for r in got if len(r[0]) < 1000] == want
    counts = {r[0]: r[3:5] for r in got if len(r[0]) > 1000}
    drop = [zlib.crc32(f"{len(texts) - 3}:{w}".encode()) % 31 == 0 for w in (long, long[:-1])]
    assert drop != [False, False] or counts == {long: (2, 1), long[:-1]: (3, 1)}
    assert any(r[1] and r[1] != r[2] for r in got)  # a form that has a form
    assert spelling.variants(table(spark, [])).count() == 0


def test_trie_numbers_are_those_of_prefixes(spark):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    rows = spelling.number_nodes(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    number = defaultdict(set)
    for r in rows:
        assert len(r.path) == len(r.name) + 1
        for i, node in enumerate(r.path):
            number[r.name[:i]].add(node)
    assert all(len(v) == 1 for v in number.values()) and len({*map(frozenset, number.values())}) == len(number)
    assert [r.name for r in sorted(rows, key=lambda r: r.place)] == names
