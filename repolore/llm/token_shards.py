"""Token-id shards in training order.

Every text becomes token ids and an end mark, cut into sequences of ``length`` ids (the last one padded). Sequence ``i`` of
``n`` gets slot ``permute(i)`` of a keyed Feistel network over the next even power of two, walked until it falls below ``n``: a
bijection, so slots are 0 .. n-1 without sorting or shuffling by a random key. Slots go to shards by range, one shard per
partition, so each file holds its slots in order.

A record is ``stride`` bytes: doc_id int64, number of the sequence int32, ids in it int32, the ids as uint16 (little-endian), and a
newline, which only Spark's text writer needs. The record of slot ``s`` is in shard ``s // per_shard`` at
``(s % per_shard) * stride``, so a reader resumes anywhere without an index.

The index of a sequence is its place in the scan of ``docs``: partition, then row. ``docs`` is read twice (to count, then to
write), and each partition's second reading is held against the first; give a table that reads the same way twice, such as
files. Null and empty texts make one sequence that holds the end mark. A null ``doc_id`` is written as the least int64. Rows that repeat
are written again, texts of any length whole; an empty table makes no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.llm.bpe import LONG_GAP, PIECES, SPACE, between_long_gaps
from repolore.session import cut_lineage, scratch_dir

NO_ID = -(1 << 63)
#: Characters from which a text's ids are held as an array at once.
LONG = 1_000_000
#: The pattern for texts where no two characters of white space meet: without looking ahead, so the engine reads it faster.
SINGLE = PIECES.removesuffix(rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+") + rf"[{SPACE}]"
_MEET = re.compile(rf"[{SPACE}]{{2}}")
_HEAD = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4")])
_PART = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_seqs", pa.int64()), ("digest", pa.int64())])
_SEQ = pa.schema([("slot", pa.int64()), ("record", pa.binary())])
_READ = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("ids_hash", pa.int64())])


class Ids:
    """Token ids of whole texts by a ranks file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 65_535:
            raise ValueError("ids do not fit 16 bits")
        self.end = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("shards", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.ranks = self.encoding.encode_ordinary
        self.single = tiktoken.Encoding("single", pat_str=SINGLE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.gap = tiktoken.Encoding("gaps", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        x = self._ids(text)
        return np.asarray(array("H", x) if isinstance(x, list) else x, "<u2").tobytes()

    def count(self, text: str) -> int:
        return len(self._ids(text))

    def _ids(self, text: str) -> list[int] | np.ndarray:
        # the list is made faster, the array is smaller
        if len(text) < LONG_GAP:
            return self.ranks(text) if _MEET.search(text) else self.single(text)
        whole = lambda x: self.ranks(x) if len(x) < LONG else self.encoding.encode_to_numpy(x, disallowed_special=())
        parts = [np.asarray(self.gap.encode_ordinary(x) if one else whole(x), "<u2") for x, one in between_long_gaps(text)]
        return np.concatenate(parts)


_LOADED: dict[str, Ids] = {}


def ids(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of ``index`` (all below ``n``): balanced Feistel over the least 4**k that holds ``n``, with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True), r + 1)) for r in range(rounds)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (A.mix(right ^ k) & mask)
        x = left << shift | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def _n_seqs(n_ids: int, length: int) -> int:
    return n_ids // length + 1  # with the end mark, never empty


def _count(path: str, length: int):
    def run(part, batches):
        enc, docs, seqs, check = ids(path), 0, 0, xxhash.xxh3_64()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                k = _n_seqs(enc.count(text), length)
                docs, seqs = docs + 1, seqs + k
                check.update(k.to_bytes(8, "little"))
        yield A.rows(_PART, {"part": [part], "n_docs": [docs], "n_seqs": [seqs], "digest": [check.intdigest() >> 1]})

    return run


def _in_task(fn):
    def run(batches):
        from pyspark import TaskContext

        return fn(TaskContext.get().partitionId(), batches)

    return run


def _emit(path: str, length: int, key: int, total: int, starts: dict[int, tuple[int, int, int]]):
    """``starts``: first index, sequences and digest by partition."""

    def out(heads, bodies, first):
        head = np.array(heads, _HEAD).view(np.uint8).reshape(len(heads), -1)
        body = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(heads), -1)
        record = np.concatenate([head, body], 1)
        size = record.shape[1]
        slots = permute(np.arange(first, first + len(heads)), total, key)
        offsets = pa.py_buffer((np.arange(len(heads) + 1) * size).astype(np.int32).tobytes())
        column = pa.Array.from_buffers(pa.binary(), len(heads), [None, offsets, pa.py_buffer(record.tobytes())])
        return A.rows(_SEQ, {"slot": pa.array(slots), "record": column})

    def run(part, batches):
        enc, check = ids(path), xxhash.xxh3_64()
        first, want, digest = starts.get(part, (0, 0, None))
        end = np.array([enc.end], "<u2").tobytes()
        done, heads, bodies = 0, [], []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = enc.of(text) + end
                n = len(x) // 2
                k = -(-n // length)
                check.update(k.to_bytes(8, "little"))
                bodies.append(x + bytes(2 * (k * length - n)))
                heads += [(NO_ID if doc is None else doc, i, min(length, n - i * length)) for i in range(k)]
                if len(heads) >= 20_000:
                    yield out(heads, bodies, first + done)
                    done, heads, bodies = done + len(heads), [], []
        if heads:
            yield out(heads, bodies, first + done)
        if digest is not None and (done + len(heads), check.intdigest() >> 1) != (want, digest):
            raise RuntimeError("a partition of the documents changed between counting and writing")

    return run


def _starts(docs: DataFrame, path: str, length: int) -> tuple[dict[int, tuple[int, int, int]], int]:
    """First index of each partition: one small row per scan task comes to the driver, none per document."""
    counted = cut_lineage(docs.mapInArrow(_in_task(_count(path, length)), "part int, n_docs long, n_seqs long, digest long"))
    at, out = 0, {}
    for row in counted.filter("n_docs > 0").orderBy("part").toLocalIterator():
        out[row.part] = at, row.n_seqs, row.digest
        at += row.n_seqs
    return out, at


def write_shards(docs: DataFrame, path: str, vocabulary: str, length: int = 256, shard_bytes: int = 32 << 20, key: int = 1) -> dict:
    """Write the shards of ``docs`` (``doc_id, text``) below ``path``; returns the layout that ``read_shards`` takes."""
    texts = A.with_text(docs, "doc_id").select(F.col("doc_id").cast("long"), "text")
    starts, total = _starts(texts, vocabulary, length)
    stride = _HEAD.itemsize + 2 * length + 1
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-total // per_shard))
    layout = {"path": path, "length": length, "stride": stride, "per_shard": per_shard, "shards": shards, "total": total}
    rows = texts.mapInArrow(_in_task(_emit(vocabulary, length, key, total, starts)), "slot long, record binary")
    rows = rows.repartitionById(shards, F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot")
    # the text writer adds one newline to the bytes of a record; it reads nothing into them
    rows.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(path)
    return layout


def read_shards(spark: SparkSession, layout: dict) -> DataFrame:
    """``slot, shard, byte_offset, doc_id, seq, n_ids, ids_hash`` of every record, from the files."""
    files = spark.read.format("binaryFile").load(layout["path"] + "/part-*").select("path", "content")
    stride, per_shard, length = layout["stride"], layout["per_shard"], layout["length"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                if len(data) % stride:
                    raise ValueError(f"{name} does not hold whole records")
                data = data.reshape(-1, stride)
                if not len(data):
                    continue
                shard = int(regex.search(r"part-(\d+)", name)[1])
                head = np.ascontiguousarray(data[:, : _HEAD.itemsize]).view(_HEAD).ravel()
                body = np.ascontiguousarray(data[:, _HEAD.itemsize : -1])
                hashes = [xxhash.xxh3_64_intdigest(x[: 2 * k].tobytes()) >> 1 for x, k in zip(body, head["n"], strict=True)]
                at = np.arange(len(data))
                doc = pa.array(head["doc_id"].astype(np.int64), mask=head["doc_id"] == NO_ID)
                for i in range(0, len(data), 10_000):
                    s = slice(i, i + 10_000)
                    yield A.rows(_READ, {"slot": shard * per_shard + at[s], "shard": np.full(len(at[s]), shard), "byte_offset": at[s] * stride, "doc_id": doc[s], "seq": head["seq"][s].astype(np.int64), "n_ids": head["n"][s].astype(np.int64), "ids_hash": hashes[s]})

    assert length * 2 + _HEAD.itemsize + 1 == stride
    return files.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, seq long, n_ids long, ids_hash long")


def read_sequences(spark: SparkSession, layout: dict) -> DataFrame:
    """``slot, doc_id, seq, ids`` of every record: for training jobs, and for tests of the round trip."""
    files = spark.read.format("binaryFile").load(layout["path"] + "/part-*").select("path", "content")
    schema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("ids", pa.list_(pa.int32()))])
    stride, per_shard = layout["stride"], layout["per_shard"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                shard = int(regex.search(r"part-(\d+)", name)[1])
                for i in range(0, len(data), 10_000):
                    head = np.ascontiguousarray(data[i : i + 10_000, : _HEAD.itemsize]).view(_HEAD).ravel()
                    body = np.ascontiguousarray(data[i : i + 10_000, _HEAD.itemsize : -1]).view("<u2")
                    rows = [x[:k].astype(np.int32) for x, k in zip(body, head["n"], strict=True)]
                    doc = pa.array(head["doc_id"].astype(np.int64), mask=head["doc_id"] == NO_ID)
                    yield A.rows(schema, {"slot": shard * per_shard + np.arange(i, i + len(head)), "doc_id": doc, "seq": head["seq"].astype(np.int64), "ids": rows})

    return files.mapInArrow(run, "slot long, doc_id long, seq long, ids array<int>")


def materialise(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the shards to a new shared folder and return what their files hold."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, scratch_dir(spark, "shards"), vocabulary, **options))
