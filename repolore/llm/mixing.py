"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. A text's size is its number of words. Sources, in code-point order with null last, take the weights in turn and share
   ``ratio`` times all words; a target stops at ``most`` times its source's size, and the excess is shared again by weight.
2. The mix is counted in equal blocks of ``unit`` words: ``block``, or less where the smallest target asks for it (a sixteenth of it).
   Blocks go to sources by the highest quotients target / (2k - 1), then each source's blocks to its shards by the quotients
   of their sizes: integer quotas per shard. Only quotients near a share are ever listed, so their number follows the sources.
3. A shard is dealt its documents by a hash; a source has as many shards as its own words need. In a shard, documents in seeded order
   form a stream, cut into lots of about ``block`` words.
4. A shard takes whole passes over its stream, and the rest of its quota as lots in seeded order, of the last one its first words.

A document's ``taken`` words are its share of the lots taken. Null and empty texts have size 0 and are never taken; an empty table gives
an empty mix. The hash of (doc_id, text, source) orders a shard, so reruns agree, whatever the order of the rows; equal rows are
rows of their own, which one of them takes what is a matter of chance. Other columns pass through ``taken_rows``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repolore.session import broadcast_if_small, cut_lineage

#: Name of a column that no table has.
CUTS = "cuts\x01"
WORD = r"[^\x20\x09-\x0D]+"


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))


def sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _row_key().alias("rk"))


def targets(sized: DataFrame, weights: tuple[float, ...], ratio: float, most: float) -> DataFrame:
    """``source, source_size, target``: one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    sources = cut_lineage(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")))
    capped = F.col("source_size") * most
    left = sources.agg(F.sum("source_size") * ratio).first()[0] or 0.0
    level = 0.0  # words per unit of weight
    while True:
        full = capped <= F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, capped)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        rise = (left - (row.used or 0.0)) / row.open
        if rise <= level:
            break
        level = rise
    return sources.select("source", "source_size", F.least(capped, F.col("weight") * level).alias("target"))


def apportion(parties: DataFrame, within: list[str], votes: str, seats: Column, most: Column | None = None) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` given to the highest quotients votes / (2k - 1) inside each group of ``within``.

    A party's quota is near its exact share: it moves by at most half the number of parties, in proportion to the share. So
    the quotients below that range win for sure, those above lose, and only those inside are ranked; the
    rows ranked stay in proportion to the parties. ``most`` bounds a party's quota.
    """
    group = W.partitionBy(*within)
    df = parties.withColumn("_seats", seats.cast("long")).withColumn("_all", F.sum(votes).over(group)).withColumn("_n", F.count("*").over(group))
    share = F.when(F.col("_all") > 0, F.col("_seats") * F.col(votes) / F.col("_all")).otherwise(0.0)
    spread = F.when(F.col("_seats") > 0, share * F.col("_n") / (2 * F.col("_seats"))).otherwise(0.0)
    df = df.withColumn("_low", F.greatest(F.lit(0), F.floor(share - spread) - 1)).withColumn("_high", F.ceil(share + spread) + 1)
    if most is not None:
        df = df.withColumn("_high", F.least(F.col("_high"), most.cast("long"))).withColumn("_low", F.least("_low", "_high"))
    df = df.withColumn("_sure", F.sum("_low").over(group))
    keys = parties.columns
    tries = df.filter("_high > _low").select("*", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    order = W.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc(), *[F.col(c) for c in keys])
    won = tries.filter(F.col(votes) > 0).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_seats") - F.col("_sure"))
    more = won.groupBy(*[F.col(c).alias(f"_won_{c}") for c in keys]).agg(F.count("*").alias("_more"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in keys])
    return df.join(more, on, "left").select(*keys, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("quota"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    return left.join(renamed, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]), how).drop(*[f"_r_{c}" for c in keys])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, most: int = 2, block: int = 128, shard_words: int = 1_000_000, seed: int = 1) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, passes, spans, rk`` for every row of ``docs`` (``doc_id, text, source``).

    ``passes``: times the whole document is taken; ``spans``: word ranges (start, end) taken once more; ``rk``: the row's key.
    """
    sized = cut_lineage(sizes(docs))
    goal = cut_lineage(targets(sized, weights, ratio, most))
    # by a source's own words, so that a small source is one stream
    n_shards = goal.filter("source_size > 0").select("source", F.ceil(F.col("source_size") / shard_words).alias("n_shards"))
    dealt = _same(sized.filter("size > 0"), broadcast_if_small(n_shards), ["source"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("rk", F.lit(seed)), F.col("n_shards")).cast("int")).drop("n_shards")
    stream = W.partitionBy("source", "shard").orderBy(F.xxhash64("rk", F.lit(seed + 1)), "rk")
    dealt = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)))
    dealt = cut_lineage(dealt.withColumn("start", F.col("end") - F.col("size")))
    shards = cut_lineage(dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")))

    total, least = goal.filter("target > 0").agg(F.sum("target"), F.min("target")).first()
    unit = max(1, min(block, int((least or 0) / 16)))
    quotas = apportion(goal.withColumn("_one", F.lit(1)), ["_one"], "target", F.lit(round((total or 0.0) / unit))).select("source", F.col("quota").alias("seats"))
    by_shard = _same(shards, cut_lineage(quotas), ["source"]).select("source", "shard", "words", "seats")
    by_shard = apportion(by_shard, ["source"], "words", F.col("seats"), F.ceil(F.col("words") * most / unit))
    by_shard = by_shard.withColumn("quota", F.least(F.col("quota") * unit, F.col("words") * most))
    by_shard = by_shard.withColumn("lots", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    by_shard = cut_lineage(by_shard.select("source", "shard", "words", "lots", F.expr("quota div words").alias("passes"), F.expr("quota % words").alias("rest")))

    # lot j holds words floor(j * words / lots) up to floor((j + 1) * words / lots)
    low, high = F.expr("lot * words div lots"), F.expr("(lot + 1) * words div lots")
    lots = by_shard.filter("rest > 0").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "lot", F.lit(seed + 2)), "lot")
    before = F.sum(high - low).over(order.rowsBetween(W.unboundedPreceding, 0)) - (high - low)
    chosen = lots.withColumn("use", F.least(high - low, F.col("rest") - before)).filter("use > 0").select("source", "shard", "lot", "use")

    placed = _same(dealt, by_shard, ["source", "shard"])
    first, last = F.expr("(start * lots + lots - 1) div words"), F.expr("((end - 1) * lots + lots - 1) div words")
    first = F.when(F.expr("((start * lots + lots - 1) div words) * words div lots > start"), first - 1).otherwise(first)
    last = F.when(F.expr("(((end - 1) * lots + lots - 1) div words) * words div lots > end - 1"), last - 1).otherwise(last)
    cut = placed.withColumn("lot", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("lots") - 1))))
    got = _same(cut, chosen, ["source", "shard", "lot"], "left")
    got = got.withColumn("lo", F.greatest("start", low)).withColumn("hi", F.least("end", high, low + F.coalesce("use", F.lit(0))))
    hit = F.col("hi") > F.col("lo")
    span = F.when(hit, F.struct((F.col("lo") - F.col("start")).alias("start"), (F.col("hi") - F.col("start")).alias("end")))
    # a place in the stream is one row of the table, whatever it has in common with others
    per = got.groupBy("source", "shard", "start", "rk", "doc_id", "size", "passes").agg(F.sum(F.when(hit, F.col("hi") - F.col("lo")).otherwise(0)).alias("more"), F.sort_array(F.collect_list(span)).alias("spans"))
    per = per.select("doc_id", "source", "size", (F.col("passes") * F.col("size") + F.col("more")).cast("long").alias("taken"), "passes", "spans", "rk")
    none = sized.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("passes"), F.lit(None).cast(per.schema["spans"].dataType).alias("spans"), "rk")
    out = _same(per.unionByName(none), goal, ["source"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "spans", "rk")


def _pieces(batches):
    word = regex.compile(WORD)
    for batch in batches:
        texts, cuts = batch.column("text").to_pylist(), batch.column(CUTS).to_pylist()
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            if spans is None:
                out.append(text)
                continue
            at = [m.span() for m in word.finditer(text)]
            out.append(" ".join(text[at[s["start"]][0] : at[s["end"] - 1][1]] for s in spans))
        names = [n for n in batch.schema.names if n not in ("text", CUTS)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.string())], names=[*names, "text"])


def taken_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row per whole pass, and one of the words in ``spans`` (runs joined by a space)."""
    # inside the job, columns have names that no table has
    key, passes, spans, cuts = "rk\x01", "passes\x01", "spans\x01", CUTS
    got = mixed.filter("taken > 0").select(F.col("rk").alias(key), F.col("passes").alias(passes), F.col("spans").alias(spans))
    rows = docs.withColumn(key, _row_key()).dropDuplicates([key]).join(got, key)
    span = F.when(F.size(spans) > 0, F.array(F.col(spans))).otherwise(F.array())
    whole = F.array_repeat(F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), F.col(passes).cast("int"))
    rows = rows.select(*docs.columns, F.explode(F.concat(whole, span)).alias(cuts))
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", text string"
    out = rows.select(*others, "text", cuts).mapInArrow(_pieces, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
