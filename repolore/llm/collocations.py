"""Phrases whose words stand together more often than their parts alone would, by Toivonen mining.

A text's A-Z are lowered, it is cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A phrase is a
run of words inside one piece; everything is counted per ``lang``.

1. *Sample.* A share of the documents proposes the words and phrases that seem frequent at a lowered threshold.
2. *Full pass.* All documents count the proposed phrases together with their negative border: every word, and every phrase that is
   not proposed though both phrases of one word less inside it are. So a phrase is counted if its two shorter parts are proposed.
3. *Expansion.* A frequent phrase of the border may be part of a longer one that nothing has counted. All such failures are proposed
   too, and another full pass counts what that newly admits; this repeats until no phrase of the border is frequent.
4. The passes count 64-bit hashes, which can only count too much. A last one counts the frequent phrases by their texts.

Proposals go to the tasks as one bitmap of ``bits`` bits, whatever the size of the input. Phrases that share a bit by chance are
counted in vain. A task adds up a stretch of words before the shuffle.

Null texts are empty, a null ``lang`` is ``und``; other columns are ignored, each row counts for itself, and an empty table has no
phrases. A text is handled whole, in numbers of its words; words may have any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.session import cut_lineage

BREAK = b"."
#: Lowers A-Z; separators become BREAK, tabs spaces.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else 46 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256)
)
_HASHES = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("a", pa.binary())])
_FOUND = pa.schema([("hash", pa.int64()), ("fresh", pa.bool_())])
_OUT = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])
#: Bytes of phrases in one batch.
_BATCH = 32 << 20


class _Numbers(dict):
    """A number per word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _has(bitmap: np.ndarray | None, hashes: np.ndarray, default: bool) -> np.ndarray:
    """Whether each hash's bit is set; without a bitmap, all are (or none)."""
    return np.full(len(hashes), default) if bitmap is None else A.in_bitmap(bitmap, hashes)


def _levels(lang: str, x: np.ndarray, hashes: np.ndarray, longest: int, new, old):
    """(k, numbers of the words of each phrase, hashes, counts) of the phrases that ``new`` admits and ``old`` does not.

    A phrase is admitted if both its parts of one word less are members: proposed, and so their own parts. The last bit of a hash
    says whether the phrase has ``longest`` words, which are part of no other.
    """
    h = A.mix(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) & ~np.uint64(1)
    counts = np.bincount(x, minlength=len(h))
    grams = np.arange(len(h))[:, None]
    if old is None:
        hit = np.flatnonzero(counts[1:]) + 1  # 0 is the break
        yield 1, grams[hit], h[hit], counts[hit]
    is_new, is_old = _has(new, h, True), _has(old, h, False)
    is_new[0] = is_old[0] = False
    for k in range(2, longest + 1):
        at = np.flatnonzero(is_new[x[:-1]] & is_new[x[1:]])
        keys, inverse, counts = np.unique(x[at] * np.int64(len(h)) + x[at + 1], return_inverse=True, return_counts=True)
        left, right = keys // len(h), keys % len(h)
        done = is_old[left] & is_old[right]
        x, grams = np.full(len(x) - 1, len(keys)), np.concatenate([grams[left], grams[right][:, -1:]], 1)
        x[at] = inverse
        h = A.mix(h[left] * A._ODD + h[right]) & ~np.uint64(1) | np.uint64(k == longest)
        hit = np.flatnonzero(~done)
        yield k, grams[hit], h[hit], counts[hit]
        # positions without a phrase carry one more number, which is no member
        is_new, is_old = np.r_[_has(new, h, True), False], np.r_[_has(old, h, False) & done, False]
        h, grams = np.r_[h, np.uint64(0)], np.concatenate([grams, np.zeros((1, k), grams.dtype)])


def _in_stretches(flush):
    """Runs ``flush(words by language as numbers, words)`` for each stretch of a task's texts."""

    def run(batches):
        parts, numbers, size = {}, _Numbers({BREAK: 0}), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().translate(_PLAIN).replace(BREAK, b" . ").split()
                words.append(BREAK)
                parts.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= A.FLUSH:
                    yield from flush({k: np.concatenate(v) for k, v in parts.items()}, list(numbers))
                    parts, numbers, size = {}, _Numbers({BREAK: 0}), 0
        if parts:
            yield from flush({k: np.concatenate(v) for k, v in parts.items()}, list(numbers))

    return run


def _array(bitmap):
    return None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)


def _send_hashes(longest: int, n: int, new=None, old=None):
    def flush(parts, words):
        hashes, hs, counts = A.hash_items(words), [], []
        for lang, x in parts.items():
            for _, _, h, a in _levels(lang, x, hashes, longest, _array(new), _array(old)):
                hs.append(h)
                counts.append(a.astype("<u4"))
        h, a = np.concatenate(hs), np.concatenate(counts)
        for b, i in A.by_bucket(A.bucket_of(h, n).astype(np.int32), n):
            yield A.rows(_HASHES, {"bucket": [b], "hash": [h[i].astype("<u8").tobytes()], "a": [a[i].tobytes()]})

    return _in_stretches(flush)


def _judge(at_least: int, now=None):
    """Hashes of a bucket with ``at_least`` occurrences; ``fresh``: not proposed, and part of longer phrases."""

    def run(table: pa.Table) -> pa.Table:
        h, a = A.join_blobs(table, "hash", "<u8"), A.join_blobs(table, "a", "<u4")
        order = np.argsort(h)
        h, a = h[order], a[order].astype(np.int64)
        start, _ = A.runs(h)
        h = h[start][np.add.reduceat(a, start) >= at_least] if len(start) else h
        fresh = ~_has(_array(now), h, False) & (h & np.uint64(1) == 0)
        return pa.table([pa.array(A.signed(h)), pa.array(fresh)], schema=_FOUND)

    return run


def _frequent_hashes(texts: DataFrame, longest: int, at_least: int, now=None, before=None) -> DataFrame:
    sent = texts.mapInArrow(_send_hashes(longest, A.n_buckets(texts.sparkSession), now, before), "bucket int, hash binary, a binary")
    return cut_lineage(sent.groupBy("bucket").applyInArrow(_judge(at_least, now), "hash long, fresh boolean"))


def _send_texts(longest: int, frequent):
    """``lang, k, phrase, a`` of the phrases whose hash and whose parts' hashes are frequent; ``k`` 0 for all words of a language."""

    def batches_of(lang, k, words, grams, counts):
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[grams].sum(1) + k
        part = np.cumsum(sizes) // _BATCH
        cuts = np.unique(np.r_[np.flatnonzero(np.diff(part)) + 1, np.arange(0, len(grams), 100_000), len(grams)])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            texts = pc.binary_join_element_wise(*[words.take(pa.array(grams[i:j, c])) for c in range(k)], " ")
            yield A.rows(_OUT, {"lang": [lang] * (j - i), "k": np.full(j - i, k, np.int32), "phrase": texts, "a": counts[i:j].astype(np.int64)})

    def flush(parts, words):
        bitmap, hashes, words = _array(frequent), A.hash_items(words), pa.array(words, pa.binary()).cast(pa.string())
        for lang, x in parts.items():
            yield A.rows(_OUT, {"lang": [lang], "k": [0], "phrase": [""], "a": [int(np.count_nonzero(x))]})
            for k, grams, h, counts in _levels(lang, x, hashes, longest, bitmap, None):
                hit = _has(bitmap, h, True)
                yield from batches_of(lang, k, words, grams[hit], counts[hit])

    return _in_stretches(flush)


def frequent_phrases(docs: DataFrame, min_count: int = 10, longest: int = 3, sample: float = 0.25, bits: int = 26) -> DataFrame:
    """``lang, k, phrase, a``: every phrase of 1 to ``longest`` words with ``a`` >= ``min_count``; ``k`` 0: all words of the language."""
    sc = docs.sparkSession.sparkContext
    texts = A.with_text(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text", F.col("doc_id").alias("_doc")), "lang", "_doc")
    lot = F.pmod(F.xxhash64("_doc", "text", F.lit(11)), F.lit(1 << 20)) < int(sample * (1 << 20))
    drawn, texts = texts.filter(lot).drop("_doc"), texts.drop("_doc")
    now = A.bitmap_of(_frequent_hashes(drawn, longest, max(1, round(0.8 * sample * min_count))), "hash", bits)
    shared = sc.broadcast(now)
    found = _frequent_hashes(texts, longest, min_count, shared)
    frequent = A.bitmap_of(found, "hash", bits)
    while not (failures := found.filter("fresh")).isEmpty():
        now, before = A.bitmap_of(failures, "hash", bits, now), shared
        shared = sc.broadcast(now)
        found = _frequent_hashes(texts, longest, min_count, shared, before)
        frequent = A.bitmap_of(found, "hash", bits, frequent)
    counted = texts.mapInArrow(_send_texts(longest, sc.broadcast(frequent)), "lang string, k int, phrase string, a long")
    counted = counted.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))
    return cut_lineage(counted.filter((F.col("a") >= min_count) | (F.col("k") == 0)))


def _cuts(df: DataFrame, longest: int) -> DataFrame:
    """One row per place where a phrase can be cut: ``cut`` words to the ``left``, the others to the ``right``."""
    left = F.expr("substring_index(phrase, ' ', cut)")
    return df.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("left", left).withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))


def scored(frequent: DataFrame, longest: int = 3, absorb: int = 50) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates: phrases of two words and more that no longer one absorbs.

    The score is floor(10**6 * a * a / (l * r)) of the lowest cut (the first of equals), in decimals of 38 digits. A longer phrase
    absorbs those inside it that have at most 100 / ``absorb`` times its occurrences.
    """
    many = frequent.filter("k > 1")
    part = frequent.filter("k > 0 and k < " + str(longest)).select("lang", F.col("phrase").alias("part"), F.col("a").alias("n_part"))
    cut = _cuts(many, longest)
    for side, count in (("left", "l"), ("right", "r")):
        p = part.select("lang", F.col("part").alias(side), F.col("n_part").alias(count))
        cut = cut.join(p, ["lang", side])
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "k").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # the phrases inside a longer one, each with the most occurrences of one that holds it
    inner = many.filter("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("from", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("size"))))
    inner = inner.select("lang", F.expr("substring_index(substring_index(phrase, ' ', from + size), ' ', -size)").alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    return kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def top_phrases(rated: DataFrame, keep: int = 2000, parts: int = 64) -> DataFrame:
    """The first ``keep`` of each lang with ``rank``. Each of ``parts`` shares of a lang is cut down first, so that no task sorts a whole lang."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = rated.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= keep)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep).drop("part")


def collocations(docs: DataFrame, min_count: int = 10, longest: int = 3, keep: int = 2000, absorb: int = 50, **mining) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``keep`` best phrases of each language of ``docs`` (``doc_id, text, lang``)."""
    found = frequent_phrases(docs, min_count, longest, **mining)
    n = found.filter("k = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return top_phrases(scored(found, longest, absorb), keep).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
