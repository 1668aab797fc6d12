"""The pipeline's stages and its whole run against plain versions, on tables with null and repeated ids and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from repolore.llm import decontaminate, mixing, quality_rules
from repolore.session import scratch_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, _w string, rk long, task string"
ITEM = "a farmer plants seven rows of young pear trees beside the old stone wall and waters each of them twice"


def text_of(rnd, n=40):
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


def rows():
    rnd = random.Random(8)
    base = [text_of(rnd) for _ in range(30)]
    near = [t.replace(t.split()[20], "changed") if i % 2 else t + " more" for i, t in enumerate(base[:10])]
    leak = [f"{text_of(rnd, 15)} {ITEM} {text_of(rnd, 15)}"]
    junk = ["## $$ %% " * 20, "one two", "same words here again " * 12]
    texts = base + near + leak + junk + [base[12], None, "", "alone"]
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t), "keep me", "mine", i, None) for i, t in enumerate(texts)]
    out += [(None, text_of(rnd), "en", "s1", 3, "keep me", "x", 1, None), (None, base[3], "en", "s1", 3, None, "x", 2, None)]  # ids are null
    out += [(5, text_of(rnd), "en", "s2", 3, "keep me", "x", 3, None), (5, ITEM, "en", "s2", 3, "keep me", "x", 4, None)]  # one id, several texts
    out += [out[7], out[7]]  # whole rows again
    out += [(500 + i, text_of(rnd, 3) + f" u{i}", "en", "tiny", 3, "keep me", "x", 5, None) for i in range(2)]
    return out


@pytest.fixture
def sf_dir(spark):
    path = scratch_dir(spark, "pipeline-test")
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], int(r[1] is not None and "$$" not in r[1]), 0) for r in data if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_each(data):
    data = list(dict.fromkeys(data))
    group = list(range(len(data)))
    sets = [shingles(r[1]) for r in data]
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    held = defaultdict(list)
    for g, r in zip(group, data, strict=True):
        held[g].append(r)
    return held.values()


def test_good_rows_keep_their_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = P.keep_good(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = Counter(map(tuple, got.collect()))
    judged = quality_rules.judge(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = Counter((r.doc_id, r.text) for r in judged.filter("kept").collect())
    assert Counter((r[0], r[1]) for r in kept.elements()) == keep and kept <= Counter(rows())
    assert not any(r[1] in (None, "", "one two") for r in kept)
    own = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r._w for r in own.collect()} == {"mine", "x"} and dict(own.dtypes)["words"] == "double"


def test_one_of_each_group_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter(map(tuple, P.one_per_group(spark, docs, sf_dir).collect()))
    assert set(got.values()) == {1}
    order = lambda r: (r[0] is None, r[0] or 0)
    for group in one_each(rows()):
        here = [r for r in group if r in got]
        assert len(here) == 1 and order(here[0]) == min(map(order, group))
    empty = docs.limit(0)
    assert P.one_per_group(spark, empty, sf_dir).count() == P.without_benchmark(spark, empty, sf_dir).count() == P.mix_sources(spark, empty, sf_dir).count() == 0


def test_leaks_go_and_rows_of_the_same_id_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter(map(tuple, P.without_benchmark(spark, docs, sf_dir).collect()))
    assert got == Counter(r for r in rows() if ITEM not in (r[1] or ""))


def test_mix_is_near_its_targets_and_keeps_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs).collect()
    want = {r.source: r.target for r in mixed}
    got, words = Counter(), Counter()
    for r in P.mix_sources(spark, docs, sf_dir).collect():
        got[r.source] += len(WORD.findall(r.text))
        assert (r.words, r._w) in {(x[5], x[6]) for x in rows() if x[0] == r.doc_id and x[3] == r.source}
    for r in mixed:
        words[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert got == words and all(abs(got[s] - t) <= max(1, t / 16) for s, t in want.items())


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        path = scratch_dir(spark, "stage-by-stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += r.n_ids
    by_doc = defaultdict(int)
    for (doc, n), k in want.items():
        by_doc[doc] += n * k
    assert got == by_doc and sorted(r.slot for r in out) == list(range(len(out)))
    assert not decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count()
