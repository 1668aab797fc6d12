"""URL filter lists: host-suffix and path-prefix expressions, joined on short hash prefixes.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z lower-cased), its path what then follows up to ``?``
or ``#``. It is expanded into its host suffixes (at dots) times its path prefixes, of the label counts and path lengths that the rules
have. Expressions meet rules on the first 32 bits of their SHA-256; the whole digest confirms. The longest rule
wins, then the one with the longer host, then a block. A url that no rule fits gets ``default``.

A null url, or one without ``://``, has an empty host and path and fits no rule. Repeated rows stay repeated. Rules with null
fields are ignored; an empty rule table leaves every page to ``default``. Rules are broadcast only within a checked bound, else
the join is left to AQE, which splits a hot expression's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolore.session import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", bound: int = 100_000) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` per row of ``pages``. ``rules``: ``host, path, verdict`` ('allow' or 'block')."""
    host, path = host_path(F.col("url"))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    digest = _digest(F.col("host"), F.col("path"))
    found = rules.select(
        F.substring(digest, 1, 8).alias("short"),
        digest.alias("full"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), "verdict").alias("won"),
    )
    # distinct label counts and path lengths: bounded by the longest rule, not by the number of rules
    labels = [r[0] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*map(F.lit, sorted(labels))), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    if labels:
        tries = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))
    else:
        tries = F.array().cast("array<string>")
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    seen = seen.select("*", F.posexplode_outer(tries).alias("no", "full"))
    # rules whose digests share the short prefix are one row, so an expression stays one row
    lists = found.groupBy("short").agg(F.collect_list(F.struct(F.col("full").alias("whole"), "won")).alias("rules"))
    met = seen.withColumn("short", F.substring("full", 1, 8)).join(broadcast_if_small(lists, bound), "short", "left")
    fits = F.filter("rules", lambda r: r["whole"] == F.col("full"))
    met = met.withColumn("won", F.array_max(F.transform(fits, lambda r: r["won"])))
    one = met.groupBy("page_id", "url", "host", "path").agg(F.max("won").alias("won"), F.count_if(F.coalesce(F.col("no"), F.lit(0)) == 0).cast("int").alias("copies"))
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return one.select("page_id", "url", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
