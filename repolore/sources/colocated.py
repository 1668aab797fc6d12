"""Tables stored in buckets of their join key, so that a join on that key moves the other side only.

Bucketed tables are known to the session's catalogue; where it forgets them between sessions (no metastore), ``attach``
makes a stored one known again. Written whole: a rerun replaces the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Store ``df`` below ``path`` as table ``name``: one shuffle, one sorted file per bucket. Returns the table."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option(
        "path", path
    ).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def attach(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Table ``name`` over files that ``write`` left below ``path`` with the same keys and number of buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    where = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'"
    )
    return spark.table(name)
