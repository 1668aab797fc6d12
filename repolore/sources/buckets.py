"""A versioned store of keyed records in a fixed number of bucket folders.

A record is all rows with one key. Layout below ``path``::

    data/v=<version>/bucket=<b>/      rows of the records in that bucket
    index/v=<version>/bucket=<b>/     one row per record: key, n_rows, stored_at and columns of the caller's choice
    commits/                          (bucket, version, buckets): one small file per committed write

The newest commit of a bucket names the version that holds it, so there are as many live folders as buckets, however many keys. A
write copies the buckets it touches: new records, and the old ones of the same buckets that it does not replace. It becomes
visible by its commit file alone, which comes last; a writer that fails before leaves the old versions, and the next one
overwrites what it left. One writer at a time. Readers open the buckets that their keys fall into, the catalogue only the index.
A record whose readable rows are not as many as its index says is damaged, and reads as absent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolore.session import broadcast_if_small, keep_small

COMMITS = "bucket int, version bigint, buckets int"


@dataclass(frozen=True)
class BucketStore:
    """``keys`` are string columns of ``schema``; ``about``: aggregates over a record's rows that the index keeps, by name."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    about: dict[str, Column]
    buckets: int = 64
    fmt: str = "json"

    # --- reading ---

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def live(self) -> dict[int, int]:
        """Version of each bucket that was ever written: one number per bucket."""
        rows = self._commits().groupBy("bucket").agg(F.max("version").alias("version"), F.max("buckets").alias("buckets")).collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"the store has {rows[0].buckets} buckets")
        return {r.bucket: r.version for r in rows}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _wanted(self, keys: DataFrame | None) -> dict[int, int]:
        live = self.live()
        if keys is None or not live:
            return live
        asked = {r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most one number per bucket
        return {b: v for b, v in live.items() if b in asked}

    def _rows(self, kind: str, live: dict[int, int], schema: str, fmt: str) -> DataFrame:
        """Rows of the live folders; a bucket whose last record was deleted has none."""
        paths = [f"{self.path}/{kind}/v={v}/bucket={b}" for b, v in sorted(live.items())]
        paths = [p for p in paths if self._exists(p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(fmt).load(paths)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _index_schema(self) -> str:
        typed = self.spark.createDataFrame([], self.schema).groupBy(*self.keys).agg(
            F.count("*").alias("n_rows"), *[c.alias(n) for n, c in self.about.items()]
        )
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema) + ", stored_at timestamp"

    def index(self, keys: DataFrame | None = None) -> DataFrame:
        """One row per record (of ``keys``); no record is opened."""
        rows = self._rows("index", self._wanted(keys), self._index_schema(), "parquet")
        return rows if keys is None else self._only(rows, keys)

    def _only(self, rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
        return rows.join(broadcast_if_small(keys.select(*self.keys).distinct()), list(self.keys), how)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """Rows of all whole records, or of those in ``keys``."""
        live = self._wanted(keys)
        rows = self._rows("data", live, self.schema, self.fmt)
        index = self._rows("index", live, self._index_schema(), "parquet")
        if keys is not None:
            rows, index = self._only(rows, keys), self._only(index, keys)
        found = rows.groupBy(*self.keys).agg(F.count("*").alias("_n"))
        whole = index.join(found, list(self.keys)).where("_n = n_rows").select(*self.keys)
        return rows.join(keep_small(whole), list(self.keys), "left_semi")

    # --- writing ---

    def _put(self, rows: DataFrame, kind: str, version: int, fmt: str, mode: str) -> None:
        """REBALANCE lets AQE split a hot record over several files; rows are sorted, so that files can be skipped by key."""
        placed = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        out = placed.sortWithinPartitions("bucket", *self.keys).write.mode(mode).option("partitionOverwriteMode", "static")
        out.partitionBy("bucket").format(fmt).save(f"{self.path}/{kind}/v={version}")

    def _next(self) -> int:
        return (self._commits().agg(F.max("version")).first()[0] or 0) + 1

    def _replace(self, version: int, gone: DataFrame, touched: list[int]) -> None:
        """Copies what stays in the touched buckets, then makes the version visible."""
        old = {b: v for b, v in self.live().items() if b in touched}
        for kind, schema, fmt in (("data", self.schema, self.fmt), ("index", self._index_schema(), "parquet")):
            stays = self._only(self._rows(kind, old, schema, fmt), gone, "left_anti")
            self._put(stays, kind, version, fmt, "append")
        commit = self.spark.createDataFrame([(b, version, self.buckets) for b in touched], COMMITS)
        commit.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def write(self, rows: DataFrame) -> None:
        """Replace the record of every key in ``rows``."""
        names = self.spark.createDataFrame([], self.schema).columns
        version = self._next()
        self._put(rows.select(*names), "data", version, self.fmt, "overwrite")
        try:
            new = self.spark.read.schema(self.schema + ", bucket int").format(self.fmt).load(f"{self.path}/data/v={version}")
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        except AnalysisException:  # no rows, no files
            return
        if not touched:
            return
        about = new.groupBy(*self.keys).agg(F.count("*").alias("n_rows"), *[c.alias(n) for n, c in self.about.items()])
        self._put(about.withColumn("stored_at", F.current_timestamp()), "index", version, "parquet", "overwrite")
        written = self.spark.read.schema(self._index_schema()).parquet(f"{self.path}/index/v={version}")
        self._replace(version, keep_small(written.select(*self.keys)), touched)

    def delete(self, keys: DataFrame) -> None:
        """Remove the records of ``keys``; those that are not there make no difference."""
        there = keep_small(self.index(keys).select(*self.keys))
        touched = [r.b for r in there.select(self.bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        version = self._next()
        for kind, schema, fmt in (("data", self.schema, self.fmt), ("index", self._index_schema(), "parquet")):
            self._put(self.spark.createDataFrame([], schema), kind, version, fmt, "overwrite")  # drops what a failed writer left
        self._replace(version, there, touched)
