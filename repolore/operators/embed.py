"""Vectors: pluggable embedding in Arrow batches, repair of bad vectors, coverage, reuse of stored ones."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolore import constants as C
from repolore.functions.text import is_blank
from repolore.session import cut_lineage, fits, keep_small


class Embedder(Protocol):
    """Anything that maps a list of texts to vectors of ``dim`` floats, in order."""

    dim: int

    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class HashEmbedder:
    """Deterministic stand-in: a unit vector seeded by the text. ``poison`` makes a batch fail, for tests."""

    def __init__(self, dim: int = 256, poison: str | None = None):
        self.dim, self.poison = dim, poison

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        import hashlib

        out = []
        for t in texts:
            if self.poison and self.poison in t:
                raise ValueError("embedding service refused the batch")
            seed = int.from_bytes(hashlib.blake2b(t.encode("utf-8"), digest_size=8).digest(), "big")
            v = np.random.default_rng(seed).standard_normal(self.dim)
            out.append((v / np.linalg.norm(v)).astype("float32"))
        return out


FIRST_WAIT = 0.1  # seconds
RETRY_WINDOW = 5.0


def _call(embedder: Embedder, texts: list[str], retries: int) -> tuple[list[np.ndarray] | None, str | None]:
    """Vectors of one batch, or why there are none. A failed call is made again up to ``retries`` times, after waits that
    double, within ``RETRY_WINDOW`` seconds of waiting; an answer of the wrong length is a failure."""
    wait, left = FIRST_WAIT, RETRY_WINDOW
    for attempt in range(retries + 1):
        if attempt:
            if left <= 0:
                break
            time.sleep(min(wait, left))
            wait, left = 2 * wait, left - wait
        try:
            got = [np.asarray(v, "float32") for v in embedder(texts)]
            if len(got) == len(texts):
                return got, None
            failure = f"{len(got)} vectors for {len(texts)} texts"
        except Exception as e:  # one bad batch must not end the job
            failure = str(e) or type(e).__name__
    return None, failure


def _sent(text: object) -> bool:
    return isinstance(text, str) and bool(text.strip())


#: Rows that a task turns into Python objects, and gives back, at once; what Spark hands over stays in Arrow.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, without copying."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def with_columns(part: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *columns.values()], names=[*part.schema.names, *columns])


def _vectors(rows: list) -> pa.ListArray:
    """A list column of arrays; None where a row has none."""
    ends = np.cumsum([0] + [0 if v is None else len(v) for v in rows]).astype("int32")
    flat = np.concatenate([v for v in rows if v is not None] or [np.zeros(0, "float32")]).astype("float32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([v is None for v in rows], pa.bool_()))


def embed(
    df: DataFrame, make_embedder: Callable[[], Embedder], text: str = "text", batch_size: int = C.EMBED_BATCH,
    retries: int = 0,
) -> DataFrame:
    """Add ``vector`` and ``error``. The embedder is made once per task.

    Blank texts are not sent and get a zero vector; a batch that failed ``retries`` + 1 times leaves empty vectors and its
    error text.
    """
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for b in batches:
            done, vectors, errors = 0, [], []  # rows given back, and results of those after them
            held: list = []  # texts of the batch that is being filled, blank ones among them
            n_sent = 0

            def close(held=held, vectors=vectors, errors=errors):
                send = [t for t in held if _sent(t)]
                got, failure = _call(embedder, send, retries) if send else ([], None)
                found = iter(got or ())
                for t in held:
                    sent = _sent(t)
                    vectors.append(np.zeros(embedder.dim if not sent else 0, "float32") if got is None or not sent else next(found))
                    errors.append(failure if sent else None)
                held.clear()

            for part in slices([b]):
                for t in part.column(text).to_pylist():
                    held.append(t)
                    n_sent += _sent(t)
                    if n_sent == batch_size:
                        close()
                        n_sent = 0
                if len(vectors) >= SLICE:
                    yield with_columns(b.slice(done, len(vectors)), vector=_vectors(vectors), error=pa.array(errors, pa.string()))
                    done += len(vectors)
                    vectors.clear()
                    errors.clear()
            close()
            if vectors:
                yield with_columns(b.slice(done), vector=_vectors(vectors), error=pa.array(errors, pa.string()))

    return df.mapInArrow(run, schema)


def embed_lists(
    df: DataFrame, make_embedder: Callable[[], Embedder], texts: str = "texts", retries: int = 0
) -> DataFrame:
    """Add ``vectors`` and ``error`` where each row's list is one batch, whatever Spark's partitions are.

    Rules as for ``embed``: blank and null texts get zero vectors without being sent, and one text that the service refuses
    empties the vectors of its whole list. A null list has null vectors.
    """
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("vectors", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for part in slices(batches):
            flat, ends, errors, rows = [], [0], [], part.column(texts).to_pylist()
            for row in rows:
                failure = None
                if row is not None:
                    out = [np.zeros(embedder.dim, "float32")] * len(row)
                    send = [i for i, t in enumerate(row) if _sent(t)]
                    got, failure = _call(embedder, [row[i] for i in send], retries) if send else ([], None)
                    for n, i in enumerate(send):
                        out[i] = np.zeros(0, "float32") if got is None else got[n]
                    flat += out
                ends.append(len(flat))
                errors.append(failure)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _vectors(flat), mask=pa.array([r is None for r in rows], pa.bool_()))
            yield with_columns(part, vectors=lists, error=pa.array(errors, pa.string()))

    return df.mapInArrow(run, schema)


def single_text(texts: Column) -> Column:
    """``struct(query, error)``: a query may come as a list, but only of one text."""
    one = F.size(texts) == 1
    return F.struct(
        F.when(one, F.get(texts, F.lit(0))).alias("query"),
        F.when(one, None).otherwise("only a single text can be embedded as a query").alias("error"),
    )


def zero_blank(text: Column, vector: Column, dim: int) -> Column:
    """Zero vector where the text is blank."""
    return F.when(is_blank(text), F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(vector)


def _usable() -> Column:
    return F.coalesce(F.size("vector"), F.lit(0)) > 0


def modal_dims(vectors: DataFrame, pos: str = "chunk_id", size: Column | None = None) -> DataFrame:
    """Most common vector size per repo (ties: the size seen first), from size counts only. ``size`` is for tables that
    hold sizes instead of vectors."""
    size = F.size("vector") if size is None else size
    counts = (
        vectors.where(F.coalesce(size, F.lit(0)) > 0)
        .groupBy("repo", size.alias("dim"))
        .agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))
    )
    return counts.groupBy("repo").agg(F.max_by("dim", F.struct("n", -F.col("first_pos"))).alias("dim"))


def first_dims(vectors: DataFrame, pos: str = "chunk_id") -> DataFrame:
    """Size of the first usable vector per repo."""
    return vectors.where(_usable()).groupBy("repo").agg(F.min_by(F.size("vector"), F.col(pos)).alias("dim"))


def keep_dim(vectors: DataFrame, dims: DataFrame) -> DataFrame:
    """Rows whose vector has its repo's size. ``dims`` has one row per repo and is broadcast while that is few, so
    vectors stay where they are."""
    d = keep_small(dims.select("repo", F.col("dim").alias("_dim")))
    return vectors.where(_usable()).join(d, "repo").where(F.size("vector") == F.col("_dim")).drop("_dim")


def keep_modal_dim(vectors: DataFrame, pos: str = "chunk_id") -> DataFrame:
    return keep_dim(vectors, modal_dims(vectors, pos))


def keep_first_dim(vectors: DataFrame, pos: str = "chunk_id") -> DataFrame:
    return keep_dim(vectors, first_dims(vectors, pos))


def repos_without_vectors(vectors: DataFrame, size: Column | None = None) -> DataFrame:
    """Repositories where nothing can be searched: the index step reports them as errors."""
    size = F.size("vector") if size is None else size
    return (
        vectors.groupBy("repo")
        .agg(F.count_if(F.coalesce(size, F.lit(0)) > 0).alias("valid"))
        .where("valid = 0")
        .select("repo", F.lit("no valid vectors").alias("error"))
    )


def coverage(vectors: DataFrame, pos: str = "chunk_id") -> DataFrame:
    """Per repo: missing, empty, wrong-size and valid counts. Sizes are counted first, so no row is moved."""
    size = F.size("vector")
    counts = vectors.groupBy("repo", F.when(F.col("vector").isNull(), -1).otherwise(size).alias("dim")).agg(
        F.count("*").alias("n"), F.min(pos).alias("first_pos")
    )
    usable = F.col("dim") > 0
    best = F.max_by(F.when(usable, F.col("dim")), F.when(usable, F.struct("n", -F.col("first_pos"))))
    valid = F.max(F.when(usable, F.struct("n", -F.col("first_pos"))))["n"]

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")

    return (
        counts.groupBy("repo")
        .agg(
            F.sum("n").alias("total"),
            total(F.col("dim") == -1).alias("missing"),
            total(F.col("dim") == 0).alias("empty"),
            total(usable).alias("_usable"),
            F.coalesce(valid, F.lit(0)).cast("bigint").alias("valid"),
            best.cast("bigint").alias("target_dim"),
        )
        .withColumn("wrong_size", F.col("_usable") - F.col("valid"))
        .drop("_usable")
    )


def size_histogram(vectors: DataFrame) -> DataFrame:
    return (
        vectors.where(_usable())
        .groupBy("repo", F.size("vector").cast("bigint").alias("dim"))
        .agg(F.count("*").alias("n"))
    )


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: Bits of one row of a key filter, as ``bitmap_construct_agg`` has them.
_ROW_BITS = 32_768


def maybe_among(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys`` (same column name): all that are, and few others.

    The keys' hashes set bits in a bitmap of fixed size (4 MB at most), which is broadcast, so ``df`` is thinned before it
    is shuffled; an exact join has to follow. Beyond a quarter as many keys as bits the filter would pass nearly all
    and is left out. ``keys`` is used twice: give it a checkpointed or stored table.
    """
    if not fits(keys, bits // 4):
        return df
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    place = (slot % _ROW_BITS).cast("int")
    rows = keys.select(F.floor(slot / _ROW_BITS).alias("_row"), place.cast("bigint").alias("_bit")).groupBy("_row").agg(
        F.bitmap_construct_agg("_bit").alias("_bits")
    )
    marked = df.withColumn("_slot_row", F.floor(slot / _ROW_BITS)).withColumn("_slot_bit", place)
    byte = F.expr("cast(conv(hex(substring(_bits, _slot_bit div 8 + 1, 1)), 16, 10) as int)")
    hit = (F.col("_slot_row") == F.col("_row")) & (F.getbit(byte, F.expr("_slot_bit % 8")) == 1)
    return marked.join(F.broadcast(rows), hit, "left_semi").drop("_slot_row", "_slot_bit")


def _with_hash(chunks: DataFrame) -> DataFrame:
    return chunks if "text_hash" in chunks.columns else chunks.withColumn("text_hash", text_hash(F.col("text")))


def missing_texts(chunks: DataFrame, store: DataFrame, model: str, id: str = "chunk_id") -> DataFrame:
    """Distinct texts (text_hash, text) that the store has no vector for under ``model``.

    Hashes are compared first (``chunks`` may bring them as ``text_hash``), with one id per hash (partial minimum), so a
    text that fills a third of the corpus is one row before the shuffle. Texts are then fetched by unique id; rows that
    cannot be among those asked for are dropped before the shuffle, so known texts do not move.
    """
    hashed = _with_hash(chunks).select(F.col(id).alias("_id"), "text_hash")
    known = store.where(F.col("model") == model).select("text_hash")
    todo = cut_lineage(hashed.groupBy("text_hash").agg(F.min("_id").alias("_id")).join(known, "text_hash", "left_anti"))
    texts = maybe_among(chunks.select(F.col(id).alias("_id"), "text"), "_id", todo.select("_id"))
    return texts.join(todo, "_id").select("text_hash", "text")


def embed_missing(
    chunks: DataFrame, store: DataFrame, model: str, make_embedder: Callable[[], Embedder], force: bool = False,
    id: str = "chunk_id",
) -> DataFrame:
    """New store rows (text_hash, model, vector) to append; everything again when ``force``."""
    todo = missing_texts(chunks, store.limit(0) if force else store, model, id)
    done = embed(todo, make_embedder).where("error IS NULL")
    return done.select("text_hash", F.lit(model).alias("model"), "vector")


def stored_vectors(chunks: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """(text_hash, vector, dim), checkpointed: the stored vectors that ``chunks`` (with ``text_hash``) ask for.

    Of a large store only the rows asked for are shuffled and kept. A store appended to twice by a retried job may
    hold a text twice; one row per text stays."""
    asked = cut_lineage(chunks.select("text_hash").distinct())
    rows = maybe_among(store.where(F.col("model") == model).select("text_hash", "vector"), "text_hash", asked)
    once = rows.dropDuplicates(["text_hash"]).join(asked, "text_hash", "left_semi")
    return cut_lineage(once.withColumn("dim", F.size("vector")))


def attach_vectors(chunks: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """Chunks with their stored vector (null when there is none).

    The stored side is a checkpoint: AQE splits a hot text on the chunk side only where both sides come straight from a
    shuffle."""
    hashed = _with_hash(chunks)
    return hashed.join(stored_vectors(hashed, store, model).drop("dim"), "text_hash", "left").select(
        *chunks.columns, *([] if "text_hash" in chunks.columns else ["text_hash"]), "vector"
    )
