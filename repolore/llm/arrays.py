"""Array helpers for tasks: words, hashes, window hashes, and packed buckets for shuffles.

A *packed bucket* is one row per (task flush, bucket) whose binary columns are plain little-endian arrays. It moves
hundreds of millions of hashes through a shuffle at their bare width, and lets a task combine what it holds first.
The number of buckets follows the session's shuffle partitions, so that one bucket stays small as the input grows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words (or lines) that a task gathers before it sorts and sends them on; bounds a task's memory.
FLUSH = 2_000_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def n_buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(*cols: str) -> Column:
    """64-bit key of a row; rows that agree in all ``cols`` share it and get the same result."""
    return F.xxhash64(*cols)


def with_text(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``text`` only, null text as ''."""
    return df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def hash_items(items: list[bytes], seed: int = 0) -> np.ndarray:
    if seed:
        return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in items), np.uint64, len(items))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and TAB..CR, as UTF-8; ``bytes.split`` cuts at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive items: windows of powers of two are doubled and joined in order."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out, done, power, size, left = None, 0, h, 1, width
    while left:
        if left & 1:
            part = power[done : done + n]
            out = part if out is None else mix(out * _ODD + part)
            done += size
        left >>= 1
        if left:
            power = mix(power[:-size] * _ODD + power[size:]) if len(power) > size else power[:0]
            size *= 2
    return mix(out + np.uint64(width))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the 24 high bits (more buckets than 2**24 are not used)."""
    return ((h >> np.uint64(40)) * np.uint64(min(n, 1 << 24)) >> np.uint64(24)).astype(np.int64)


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers) of the buckets that have rows."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(min(n, 1 << 24) + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), order[ends[b] : ends[b + 1]]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return start, np.diff(np.r_[start, len(sorted_keys)])


def join_blobs(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table.column(column).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def rows(schema: pa.Schema, columns: dict[str, Iterable]) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((columns[n], schema.field(n).type) for n in schema.names)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def bitmap_of(df: DataFrame, column: str, bits: int, before: bytes | None = None) -> bytes:
    """2 ** ``bits`` bits with those of the hashes in ``column`` set, added to ``before``. Whatever the input, at most
    2 ** (bits - 6) numbers reach the driver. The last bit of a hash is not looked at."""
    at = F.expr(f"shiftright({column}, 1) & {(1 << bits) - 1}L")
    slots = df.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L as int)))").alias("bits"))
    got = slots.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64) if before is None else np.frombuffer(before, np.int64).copy()
    out[got.column("slot").to_numpy()] |= got.column("bits").to_numpy()
    return out.tobytes()


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set in a bitmap (as bytes)."""
    at = hashes >> np.uint64(1) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
