"""Removal of words inside long passages that occur more than once, by fixed-block anchors.

1. Reference blocks: every document is cut into non-overlapping blocks of ``(window + 1) // 2`` words, so that any
   window of ``window`` words holds one whole block of its own document.
2. Probes: every rolling window of a block's length, of all documents, meets the blocks in buckets of their hash. A block
   is *hit* if its words also start at another place. A task sends a hash at most twice, so a passage that fills a third
   of the corpus weighs no more than one per task. Probes carry 32 bits beside their bucket; a false hit only costs work.
3. Extension: the windows around a hit block are compared whole (96 bits of all their words); those found twice are
   kept, and overlapping ones merge into maximal repeats. Again a task sends one place per distinct window.

Documents with fewer words than a window, null and empty texts keep all words. Rows that agree in ``doc_id`` and ``text``
are separate places with one result each; a null ``doc_id`` is carried through. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.llm import arrays as A

_OUT = pa.schema([("bucket", pa.int32()), ("probe", pa.binary()), ("block", pa.binary()), ("key", pa.binary()), ("no", pa.binary())])
_HIT = pa.schema([("rk", pa.int64()), ("no", pa.int32())])
_WIN_DDL = "bucket int, h1 binary, h2 binary, key binary, start binary, length binary, known boolean"
_WIN = pa.schema([("bucket", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("key", pa.binary()), ("start", pa.binary()), ("length", pa.binary()), ("known", pa.bool_())])
_SPAN = pa.schema([("rk", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])


def _at_most_two(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    start, length = A.runs(h)
    return np.sort(np.r_[h[start], h[start[length > 1]]])


def _probes(block: int, window: int, n: int):
    """Packed buckets of the rolling windows and of the reference blocks."""

    def flush(hashes: list, keys: list) -> Iterator[pa.RecordBatch]:
        probe = _at_most_two(np.concatenate(hashes))
        heads = [h[::block] for h in hashes]
        blocks = np.concatenate(heads)
        key = np.repeat(np.array(keys, np.int64), [len(x) for x in heads])
        no = np.concatenate([np.arange(len(x), dtype=np.uint32) for x in heads])
        out: dict[int, list[bytes]] = {}
        for b, i in A.by_bucket(A.bucket_of(probe, n), n):
            out[b] = [probe[i].astype("<u4").tobytes(), b"", b"", b""]
        for b, i in A.by_bucket(A.bucket_of(blocks, n), n):
            out.setdefault(b, [b""] * 4)[1:] = [blocks[i].astype("<u4").tobytes(), key[i].astype("<i8").tobytes(), no[i].astype("<u4").tobytes()]
        for b, x in out.items():
            yield A.rows(_OUT, {"bucket": [b], "probe": [x[0]], "block": [x[1]], "key": [x[2]], "no": [x[3]]})

    def run(batches):
        hashes, keys, size = [], [], 0
        for batch in batches:
            for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = A.words(text)
                if len(w) < window:
                    continue
                hashes.append(A.window_hashes(A.hash_items(w), block))
                keys.append(rk)
                size += len(w)
                if size >= A.FLUSH:
                    yield from flush(hashes, keys)
                    hashes, keys, size = [], [], 0
        if keys:
            yield from flush(hashes, keys)

    return run


def _hits(table: pa.Table) -> pa.Table:
    """Blocks of one bucket whose hash was probed from two places or more (a block is also a probe of its own)."""
    probe, block = np.sort(A.join_blobs(table, "probe", "<u4")), A.join_blobs(table, "block", "<u4")
    key, no = A.join_blobs(table, "key", "<i8"), A.join_blobs(table, "no", "<u4")
    start, length = A.runs(probe)
    twice = probe[start[length > 1]]
    at = np.searchsorted(twice, block)
    hit = np.zeros(len(block), bool)
    if len(twice):
        hit = twice[np.minimum(at, len(twice) - 1)] == block
    return pa.table([pa.array(key[hit]), pa.array(no[hit].astype(np.int32))], schema=_HIT)


def _around(blocks: list[int], block: int, window: int, n_words: int) -> np.ndarray:
    """Starts of the windows that hold one of the hit blocks whole."""
    if n_words < window:
        return np.zeros(0, np.int64)
    at = np.array(sorted(set(blocks)), np.int64) * block
    first, last = np.maximum(at + block - window, 0), np.minimum(at, n_words - window)
    mark = np.zeros(n_words + 2, np.int32)
    ok = first <= last
    np.add.at(mark, first[ok], 1)
    np.add.at(mark, last[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(mark) > 0)


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    size = 1
    out = g
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(g) - width + 1], out[width - size :][: len(g) - width + 1])


def _spans(key: np.ndarray, pos: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of consecutive positions in rows sorted by key and position."""
    go_on = (key[1:] == key[:-1]) & (pos[1:] == pos[:-1] + 1)
    for x in same:
        go_on &= x[1:] == x[:-1]
    start = np.flatnonzero(np.r_[True, ~go_on]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def _by_key(key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row per run of consecutive positions in a document."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order].astype(np.int64)
    start, length = _spans(key, pos)
    return A.rows(_SPAN, {"rk": pa.array(key[start], pa.int64()), "start": pa.array(pos[start].astype(np.int32)), "length": pa.array(length.astype(np.int32))})


def _windows(block: int, window: int, n: int):
    """Candidate windows in packed buckets, as runs of neighbours.

    The bucket comes from the least block-wide hash inside the window: equal windows share it, and so do most neighbours.
    Windows found twice in this task are known to repeat: their places go out as ``known`` runs, dealt by document, and
    one place of each still goes to its bucket to meet those of other tasks.
    """

    def rows(known, bucket, key, pos, h1=None, h2=None):
        order = np.lexsort((pos, key, bucket))
        bucket, key, pos = bucket[order], key[order], pos[order].astype(np.int64)
        h1, h2 = (x[order] if x is not None else np.zeros(0, np.uint64) for x in (h1, h2))
        ends = np.searchsorted(bucket, np.unique(bucket), side="right")
        first = 0
        for end in ends:
            start, length = _spans(key[first:end], pos[first:end])
            yield A.rows(_WIN, {
                "bucket": [int(bucket[first])], "h1": [h1[first:end].astype("<u8").tobytes()], "h2": [h2[first:end].astype("<u4").tobytes()],
                "key": [key[first:end][start].astype("<i8").tobytes()], "start": [pos[first:end][start].astype("<u4").tobytes()],
                "length": [length.astype("<u4").tobytes()], "known": [known],
            })
            first = end

    def flush(parts) -> Iterator[pa.RecordBatch]:
        h1, h2, key, pos, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((h2, h1))
        h1, h2, key, pos, bucket = h1[order], h2[order], key[order], pos[order], bucket[order]
        start = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        length = np.diff(np.r_[start, len(h1)])
        known = np.repeat(length > 1, length)
        if known.any():
            dealt = A.bucket_of(A.mix(key[known].view(np.uint64)), n)
            yield from rows(True, dealt, key[known], pos[known])
        yield from rows(False, bucket[start], key[start], pos[start], h1[start], h2[start])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for rk, text, blocks in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                w = A.words(text)
                at = _around(blocks, block, window, len(w))
                if not len(at):
                    continue
                h = A.hash_items(w)
                least = _least(A.window_hashes(h, block), window - block + 1)[at]
                second = A.window_hashes(A.hash_items(w, 1), window)[at] & np.uint64(0xFFFFFFFF)
                parts.append((A.window_hashes(h, window)[at], second, np.full(len(at), rk, np.int64), at, A.bucket_of(A.mix(least), n)))
                size += len(w)
                if size >= A.FLUSH:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _unrun(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, start, length = A.join_blobs(table, "key", "<i8"), A.join_blobs(table, "start", "<u4"), A.join_blobs(table, "length", "<u4").astype(np.int64)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(key, length), np.repeat(start.astype(np.int64), length) + inside


def _repeats(table: pa.Table) -> pa.Table:
    """Places of windows that two tasks sent, and those known before, by document."""
    flag = table.column("known")
    sent, known = table.filter(pc.invert(flag)), table.filter(flag)
    key, pos = _unrun(sent)
    h1, h2 = A.join_blobs(sent, "h1", "<u8"), A.join_blobs(sent, "h2", "<u4")
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    again = np.r_[same, False] | np.r_[False, same] if len(h1) else np.zeros(0, bool)
    key, pos = key[order][again], pos[order][again]
    more_key, more_pos = _unrun(known)
    return pa.Table.from_batches([_by_key(np.r_[key, more_key], np.r_[pos, more_pos])])


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """``rk, start, length``: runs of starts of windows that also start elsewhere, by document (key of doc_id and text)."""
    block, n = (window + 1) // 2, A.n_buckets(docs.sparkSession)
    keyed = keyed_docs(docs)
    probes = keyed.select("rk", "text").mapInArrow(_probes(block, window, n), "bucket int, probe binary, block binary, key binary, no binary")
    hits = probes.groupBy("bucket").applyInArrow(_hits, "rk long, no int")
    hits = hits.groupBy("rk").agg(F.collect_set("no").alias("blocks"))  # at most one entry per block of the document
    found = keyed.join(hits, "rk").select("rk", "doc_id", "text", "blocks")
    sent = found.mapInArrow(_windows(block, window, n), _WIN_DDL)
    return sent.groupBy("bucket").applyInArrow(_repeats, "rk long, start int, length int")


def keyed_docs(docs: DataFrame) -> DataFrame:
    return A.with_text(docs, "doc_id").withColumn("rk", A.row_key("doc_id", "text")).select("rk", "doc_id", "text")


def _per_row(column: pa.Array):
    """The (start, length) arrays of a list column's rows, None for null."""
    inner, ends, valid = column.flatten(), 0, column.is_valid().to_pylist()
    start, length = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for ok, size in zip(valid, column.value_lengths().to_pylist(), strict=True):
        if not ok:
            yield None
            continue
        yield {"start": start[ends : ends + size], "length": length[ends : ends + size]}
        ends += size


def _cut(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), _per_row(batch.column("spans")), strict=True):
                w = A.words(text)
                mask = np.zeros(len(w) + 1, np.int32)
                if spans is not None:
                    start, length = spans["start"].astype(np.int64), spans["length"].astype(np.int64)
                    np.add.at(mask, start, 1)
                    np.add.at(mask, start + length - 1 + window, -1)
                covered = np.cumsum(mask[:-1]) > 0
                n.append(len(w))
                gone.append(int(covered.sum()))
                kept.append(b" ".join([w[i] for i in np.flatnonzero(~covered)] if gone[-1] else w).decode("utf-8", "surrogatepass"))
            yield A.rows(schema, {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": n, "n_removed": gone, "kept_text": kept})

    return run


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs`` (columns ``doc_id``, ``text``; others ignored)."""
    places = repeated_windows(docs, window).groupBy("rk").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    joined = keyed_docs(docs).join(places, "rk", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
