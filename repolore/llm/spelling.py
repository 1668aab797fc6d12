"""Spelling variants: words one code point apart, grouped under far more frequent forms, by a trie-node pair dictionary.

Words are the maximal runs of ``LETTERS``, with A-Z lowered. One in ``noise`` (by a checksum of document and run) loses one code
point first. Counted are results of ``min_chars`` code points or more; those with ``min_count`` occurrences are *words*.

1. All words are sorted by range. A task walks its sorted part and numbers trie nodes: a word adds one node for each code point
   beyond what it shares with the word before. The path between two parts is shared too; one line per part (its first and last
   word, and the last one's path) is what the driver sees to join the numbers. The same again for the reversed words. So every
   prefix and every suffix has one number, and no prefix is ever written out: a word of ``k`` letters costs ``k`` numbers.
2. A word sends the pair (prefix node, suffix node) around each of its positions: without the code point there (*skip*) and between
   two code points (*insert*). Two words that meet in a pair differ by that code point alone: skip with skip by a replacement,
   skip with insert by a deletion. In a run of equal code points only the first is skipped against inserts, so
   each pair of words meets once. At most one word for each letter, and one insert, meet in a pair.
3. Counts and best neighbours are summed by word. A word's ``form`` is its most frequent neighbour (ties: the least) if that is
   ``ratio`` times as frequent or more; ``root`` follows forms by pointer doubling.

Null texts have no words; a null ``doc_id`` is empty in the checksum; rows that repeat count again; other columns are ignored; an empty table
gives an empty result. A text is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.session import cut_lineage

#: Letters after A-Z are lowered; 90 of them, which bounds the words that meet in a pair.
LETTERS = "a-zÀ-ÿ"
#: Distinct runs that a task holds before it sends their counts on.
HELD = 400_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PART = pa.schema([("part", pa.int32()), ("n_words", pa.int64()), ("n_nodes", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("path", pa.list_(pa.int64()))])
_PART_DDL = "part int, n_words long, n_nodes long, first string, last string, path array<long>"
_PAIR = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])
_PAIR_DDL = "p long, s long, kind byte, id long, n long"
INSERT, FIRST, AGAIN = 0, 1, 2


def _runs(min_chars: int, noise: int):
    find = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall

    def send(counts):
        words = list(counts)
        for i in range(0, len(words), 50_000):
            yield A.rows(_WORD, {"word": words[i : i + 50_000], "n": [counts[w] for w in words[i : i + 50_000]]})

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(find(text.encode().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), base)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield from send(counts)
                    counts = Counter()
        yield from send(counts)

    return run


def words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, noise: int = 31) -> DataFrame:
    """``word, n`` of the words of ``docs`` (``doc_id, text``)."""
    texts = A.with_text(docs, "doc_id").select(F.col("doc_id").cast("long"), "text")
    found = texts.mapInArrow(_runs(min_chars, noise), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shared(a: str, b: str) -> int:
    """Code points that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _walk(names):
    """(place, word, path in numbers of this part) of sorted words; node 0 is the root. A repeated word has the same path."""
    before, path, n_nodes = "", [0], 0
    for i, word in enumerate(names):
        common = shared(before, word)
        new = len(word) - common
        path = path[: common + 1] + list(range(n_nodes + 1, n_nodes + 1 + new))
        n_nodes += new
        before = word
        yield i, word, path, n_nodes


def _summary(batches):
    first = last = path = None
    n_words = n_nodes = 0
    for i, last, path, n_nodes in _walk(w for batch in batches for w in batch.column("name").to_pylist()):  # noqa: B007
        first = last if first is None else first
        n_words = i + 1
    if n_words:
        yield A.rows(_PART, {"part": [TaskContext.get().partitionId()], "n_words": [n_words], "n_nodes": [n_nodes], "first": [first], "last": [last], "path": [path]})


def _starts(parts) -> dict[int, tuple[int, int, np.ndarray]]:
    """Per part: words before it, nodes before it less those it shares, and the numbers of the shared path."""
    out, n_words, n_nodes, last, path = {}, 0, 0, "", np.zeros(1, np.int64)
    for row in parts:
        common = shared(last, row.first)
        known = path[: common + 1]
        out[row.part] = n_words, n_nodes - common, known
        path = _globally(np.array(row.path, np.int64), n_nodes - common, known)
        n_words, n_nodes, last = n_words + row.n_words, n_nodes + row.n_nodes - common, row.last
    return out


def _globally(path: np.ndarray, shift: int, known: np.ndarray) -> np.ndarray:
    """Numbers of the whole trie: the first word's path is 0, 1, 2 ... in its part, and its begin is known from the part before."""
    return np.where(path < len(known), known[np.minimum(path, len(known) - 1)], path + shift)


def _number(starts: dict[int, tuple[int, int, np.ndarray]]):
    def run(batches):
        done, shift, known = starts.get(TaskContext.get().partitionId(), (0, 0, np.zeros(1, np.int64)))
        # one walk over all batches; each of them comes back with two columns more
        queue: list = []

        def names():
            for batch in batches:
                if batch.num_rows:
                    queue.append(batch)
                    yield from batch.column("name").to_pylist()

        paths, sizes = [], []
        for i, _, path, _ in _walk(names()):
            paths.append(np.array(path, np.int64))
            sizes.append(len(path))
            batch = queue[0]
            if len(paths) == batch.num_rows:
                column = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(_globally(np.concatenate(paths), shift, known)))
                place = pa.array(done + np.arange(i + 1 - len(paths), i + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, place, column], names=[*batch.schema.names, "place", "path"])
                queue.pop(0)
                paths, sizes = [], []

    return run


def number_nodes(named: DataFrame) -> DataFrame:
    """``named`` with ``place`` (rank of ``name``) and ``path``: the numbers of all prefixes of ``name``, the empty one first."""
    ranged = cut_lineage(named.repartitionByRange(A.n_buckets(named.sparkSession), "name").sortWithinPartitions("name"))
    parts = ranged.select("name").mapInArrow(_summary, _PART_DDL).orderBy("part").toLocalIterator()
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", place long, path array<long>"
    return ranged.mapInArrow(_number(_starts(parts)), ddl)


def _pairs(batches):
    for batch in batches:
        prefix, suffix = batch.column("path"), batch.column("back")
        cols = [[] for _ in _PAIR.names]
        size = 0
        for i, (word, n, key) in enumerate(zip(batch.column("name").to_pylist(), batch.column("n").to_pylist(), batch.column("place").to_pylist(), strict=True)):
            p = prefix[i].values.to_numpy()
            s = suffix[i].values.to_numpy()[::-1]  # node of the suffix that begins at each position
            k = len(word)
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            skip = np.full(k, FIRST, np.int8)
            skip[1:][letters[1:] == letters[:-1]] = AGAIN
            for c, x in zip(cols, (np.r_[p[:-1], p], np.r_[s[1:], s], np.r_[skip, np.full(k + 1, INSERT, np.int8)], np.full(2 * k + 1, key), np.full(2 * k + 1, n)), strict=True):
                c.append(x)
            size += 2 * k + 1
            if size >= 200_000:
                yield A.rows(_PAIR, dict(zip(_PAIR.names, map(np.concatenate, cols), strict=True)))
                cols, size = [[] for _ in _PAIR.names], 0
        if size:
            yield A.rows(_PAIR, dict(zip(_PAIR.names, map(np.concatenate, cols), strict=True)))


def neighbours(numbered: DataFrame) -> DataFrame:
    """``id, n_near, best (n, id)`` of words that have a neighbour."""
    pairs = numbered.mapInArrow(_pairs, _PAIR_DDL)
    # the most frequent first, the least word first among equals; at most 91 words meet
    met = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "kind"))).alias("g")).filter(F.size("g") > 1)
    met = met.select("g", F.explode("g").alias("x"))
    met = met.withColumn("others", F.expr(f"filter(g, y -> y.id <> x.id and (x.kind = {FIRST} or y.kind = {FIRST} or x.kind = {AGAIN} and y.kind = {AGAIN}))"))
    met = met.filter(F.size("others") > 0)
    best = F.col("others")[0]
    near = met.select(F.col("x.id").alias("id"), F.size("others").alias("k"), F.struct(best["m"].alias("m"), best["id"].alias("id")).alias("b"))
    return near.groupBy("id").agg(F.sum("k").alias("n_near"), F.min("b").alias("b")).select("id", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.id").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for ``forms`` (``id, form``), an acyclic table: each round doubles the length of the paths followed."""
    now = cut_lineage(forms.select("id", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = cut_lineage(now.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("id", "root")
        now = now.select("id", "root")


def variants(docs: DataFrame, ratio: int = 10, **counting) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs`` (``doc_id, text``)."""
    numbered = cut_lineage(number_nodes(words(docs, **counting).select(F.col("word").alias("name"), "n")))
    backward = number_nodes(numbered.select(F.reverse("name").alias("name"), F.col("place").alias("id")))
    both = numbered.join(backward.select(F.col("id").alias("place"), F.col("path").alias("back")), "place")
    near = cut_lineage(neighbours(both))
    own = numbered.select(F.col("place").alias("id"), F.col("name").alias("word"), "n")
    rated = cut_lineage(own.join(near, "id", "left").withColumn("form_id", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))))
    formed = rated.filter("form_id is not null")
    ends = roots(formed.select("id", F.col("form_id").alias("form")))
    named = own.select(F.col("id").alias("other"), F.col("word").alias("spelled"))
    linked = formed.select("id", "form_id").join(ends, "id")
    linked = linked.join(named.withColumnsRenamed({"other": "form_id", "spelled": "form"}), "form_id").join(named.withColumnsRenamed({"other": "root", "spelled": "root_word"}), "root")
    out = rated.join(linked.select("id", "form", "root_word"), "id", "left")
    form_n = F.when(F.col("form_id").isNotNull(), F.col("best_n"))
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
