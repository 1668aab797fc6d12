"""Line deduplication by overlapping windows of consecutive lines.

A text is split at newlines; every ``window`` consecutive lines, unchanged, make a window, unless all of them are blank. The
first place of a window is the least (doc_id, line number), a null ``doc_id`` last; every later place is removed, and overlapping
removals merge. Windows are judged on the input. Fewer lines than a window, null and empty texts lose nothing. Rows with the
same ``doc_id`` hold the same places, so a first place is kept in each of them.

A task sends only its own first place of each window to the window's bucket; its other places are later ones in any case and
go to the document's bucket. So a passage in a third of all documents costs one entry per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.llm import arrays as A

LAST = (1 << 63) - 1
_COLS = ("h1", "h2", "doc", "rk", "pos")
_TYPES = ("<u8", "<u8", "<i8", "<i8", "<u4")
_SENT = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _COLS), ("later", pa.bool_())])
_SENT_DDL = "bucket int, " + ", ".join(f"{c} binary" for c in _COLS) + ", later boolean"
_PLACE = pa.schema([("rk", pa.int64()), ("pos", pa.binary())])


def lines(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _later(h1, h2, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """(order by window and place, whether the row there is at a later place than its window's first)."""
    order = np.lexsort((pos, doc, h2, h1))
    h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
    start = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(h1) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(h1)), 0)) if len(h1) else np.zeros(0, np.int64)
    return order, (doc != doc[first]) | (pos != pos[first])


def _send(window: int, n: int):
    def pack(bucket, later, cols):
        """Later places are sent without hashes: those columns are empty."""
        for b, i in A.by_bucket(bucket, n):
            blobs = {c: [x[i].astype(t).tobytes() if len(x) else b""] for c, t, x in zip(_COLS, _TYPES, cols, strict=True)}
            yield A.rows(_SENT, {"bucket": [b], **blobs, "later": [later]})

    def flush(parts):
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order, later = _later(cols[0], cols[1], cols[2], cols[4])
        cols = [x[order] for x in cols]
        if later.any():
            gone = [x[later] for x in cols]
            yield from pack(A.bucket_of(A.mix(gone[3].view(np.uint64)), n), True, [gone[0][:0], gone[1][:0], gone[2][:0], gone[3], gone[4]])
        firsts = [x[~later] for x in cols]  # with repeated ids, a first place can have several rows
        yield from pack(A.bucket_of(firsts[0], n), False, firsts)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for doc, rk, text in zip(batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = lines(text)
                k = len(x) - window + 1
                if k <= 0:
                    continue
                full = np.r_[0, np.cumsum([bool(y.split()) for y in x])]
                pos = np.flatnonzero(full[window:] > full[:-window])
                if not len(pos):
                    continue
                parts.append((A.window_hashes(A.hash_items(x), window)[pos], A.window_hashes(A.hash_items(x, 1), window)[pos], np.full(len(pos), LAST if doc is None else doc, np.int64), np.full(len(pos), rk, np.int64), pos.astype(np.uint32)))
                size += len(x)
                if size >= A.FLUSH // 2:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _judge(table: pa.Table) -> pa.Table:
    flag = table.column("later")
    sent, known = table.filter(pc.invert(flag)), table.filter(flag)
    h1, h2, doc, rk, pos = (A.join_blobs(sent, c, t) for c, t in zip(_COLS, _TYPES, strict=True))
    order, later = _later(h1, h2, doc, pos)
    key = np.r_[rk[order][later], A.join_blobs(known, "rk", "<i8")]
    pos = np.r_[pos[order][later], A.join_blobs(known, "pos", "<u4")]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    start, length = A.runs(key)
    return pa.table([pa.array(key[start], pa.int64()), pa.array([pos[s : s + k].astype("<u4").tobytes() for s, k in zip(start, length, strict=True)], pa.binary())], schema=_PLACE)


def _cut(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, blobs in zip(batch.column("text").to_pylist(), batch.column("pos").to_pylist(), strict=True):
                x = lines(text)
                covered = np.zeros(len(x), bool)
                for blob in blobs or ():
                    for k in range(window):
                        covered[np.frombuffer(blob, "<u4").astype(np.int64) + k] = True
                n.append(len(x))
                gone.append(int(covered.sum()))
                kept.append(b"\n".join([y for y, c in zip(x, covered, strict=True) if not c]).decode("utf-8", "surrogatepass"))
            yield A.rows(schema, {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_lines": n, "n_removed": gone, "kept_text": kept})

    return run


def remove_repeated_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` for every row of ``docs`` (columns ``doc_id, text``; others ignored)."""
    n = A.n_buckets(docs.sparkSession)
    keyed = A.with_text(docs, "doc_id").withColumn("rk", A.row_key("doc_id", "text")).select("rk", F.col("doc_id").cast("long"), "text")
    sent = keyed.select("doc_id", "rk", "text").mapInArrow(_send(window, n), _SENT_DDL)
    places = sent.groupBy("bucket").applyInArrow(_judge, "rk long, pos binary").groupBy("rk").agg(F.collect_list("pos").alias("pos"))
    joined = keyed.join(places, "rk", "left").select("doc_id", "text", "pos")
    return joined.mapInArrow(_cut(window), "doc_id long, n_lines long, n_removed long, kept_text string")
