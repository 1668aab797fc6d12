"""Ordered texts and top-n rows per key that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolore.session import broadcast_if_small, cut_lineage, keep_small

# Longest text put into one cell; longer ones are given as ordered blocks, which are always complete.
MAX_CELL_CHARS = 256_000_000
BLOCK_CHARS = 4_000_000
# Text that ``whole_texts`` gives as one block.
CELL_CHARS = 16_000_000


def join_text(
    parts: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    sep: str = "",
    out: str = "text",
    max_chars: int = MAX_CELL_CHARS,
) -> DataFrame:
    """(keys, n_chars, out, error): one ordered text per key.

    A key whose text would be longer than ``max_chars`` is not gathered into a cell: it has an ``error`` and no ``out``,
    and ``text_blocks`` gives its text. Such keys are found with partial sums; there are at most (all characters /
    ``max_chars``) of them, some hundred thousand in 100 TB; they are broadcast only after a check.
    """

    def length(n_chars: Column, n: Column) -> Column:
        return (n_chars + F.lit(len(sep)) * (n - 1)).cast("bigint").alias("n_chars")

    sizes = parts.groupBy(*keys).agg(length(F.sum(F.length(text)), F.count(text)))
    long = keep_small(sizes.where(F.col("n_chars") > max_chars))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    short = (
        parts.join(long.select(*keys), list(keys), "left_anti")
        .groupBy(*keys)
        .agg(length(F.sum(F.length(text)), F.count(text)), ordered.alias("_parts"))
        .select(*keys, "n_chars", F.array_join(F.transform("_parts", lambda p: p["_t"]), sep).alias(out),
                F.lit(None).cast("string").alias("error"))
    )
    why = F.concat(F.lit("a text of "), F.col("n_chars").cast("string"), F.lit(" characters does not fit one cell"))
    return short.unionByName(long.select(*keys, "n_chars", F.lit(None).cast("string").alias(out), why.alias("error")))


def text_blocks(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(keys, block, text): the ordered text of every key, of any length, cut at parts into blocks of about ``block_chars``.

    The texts of a key in order of ``block`` (0, 1, ...) give its whole text; all blocks but the first begin with ``sep``. Parts are
    dealt by ranges of (keys, order), so a key that holds a third of the rows spreads over a third of the partitions.
    Null parts are left out, as in ``join_text``; a part is never cut.
    """
    place = [*keys, *order]
    dealt = parts.where(F.col(text).isNotNull()).select(*place, F.col(text).alias("_t"))
    # the ranges are kept, so that both uses below see the same ones
    dealt = cut_lineage(dealt.repartitionByRange(*place).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sized = dealt.withColumn("_b", F.floor(F.coalesce(F.sum(F.length("_t") + len(sep)).over(before), F.lit(0)) / block_chars))
    # a part longer than a block takes the place of several
    sized = sized.withColumn("_b", F.dense_rank().over(Window.partitionBy(*keys, "_p").orderBy("_b")).cast("bigint") - 1)
    pieces = F.array_sort(F.collect_list(F.struct(*order, "_t")))
    blocks = sized.groupBy(*keys, "_p", "_b").agg(F.array_join(F.transform(pieces, lambda p: p["_t"]), sep).alias("text"))
    # numbers only: blocks of a key in earlier ranges; a key has a row per range that it lies in
    held = sized.groupBy(*keys, "_p").agg((F.max("_b") + 1).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    held = keep_small(held.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    block = (F.col("_first") + F.col("_b")).cast("bigint")
    return blocks.join(held, [*keys, "_p"]).select(
        *keys, block.alias("block"), F.when(block == 0, F.col("text")).otherwise(F.concat(F.lit(sep), "text")).alias("text")
    )


def whole_texts(
    parts: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "", out: str = "text",
    cell_chars: int = CELL_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(keys, block, out): the ordered text of every key, of any length.

    A text of up to ``cell_chars`` characters is block 0 alone; a longer one is cut at parts into blocks of about ``block_chars``,
    numbered from 0 without holes. The blocks of a key in order, put together, are its text. Keys whose parts are all null are
    left out. No text is ever gathered beyond ``cell_chars``, dropped or replaced by an error.
    """
    # the parts are read for their lengths and again for the texts; what they are made from is worked out and shuffled once
    parts = cut_lineage(parts.where(F.col(text).isNotNull()).select(*keys, *order, text))
    sizes = parts.groupBy(*keys).agg((F.sum(F.length(text)) + F.lit(len(sep)) * (F.count("*") - 1)).alias("_n"))
    # a cell of text for each key found here lies in the table, so they are few beside the text they have
    long = cut_lineage(sizes.where(F.col("_n") > cell_chars).select(*keys))
    none = long.isEmpty()
    rest = parts if none else parts.join(broadcast_if_small(long), list(keys), "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    found = rest.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["_t"]), sep).alias(out))
    found = found.select(*keys, F.lit(0).cast("bigint").alias("block"), out)
    if none:
        return found
    blocks = text_blocks(parts.join(broadcast_if_small(long), list(keys), "left_semi"), keys, order, text, sep, block_chars)
    return found.unionByName(blocks.withColumnRenamed("text", out).select(*keys, "block", out))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark cuts each task's share to ``n`` before the shuffle (WindowGroupLimit, for ``n`` up
    to ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).where(F.col(out) <= n)
