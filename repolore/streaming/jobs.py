"""Streaming jobs around the batch operators. Each micro-batch writes its own folder, so a retry overwrites it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from repolore.operators import derive, embed, generate, retrieve
from repolore.plans import flagship
from repolore.session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store that stateful processors need; a no-op where the cluster set it already."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda b: b,
    mode: str = "append", every: str | None = None,
) -> StreamingQuery:
    """Run ``each`` on every micro-batch and write the result under ``path``/batch=<id>.

    The query ends with the available data, or starts a batch ``every`` so often until it is stopped; streams with clocks (expiry, gaps)
    need the latter."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**when).start()


def live_stages(growing: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stage log of growing answers (conv_id, iteration, seq, text): every sight of a stage is logged; the current list
    is ``derive.upsert_stages`` over the log."""

    def each(batch: DataFrame) -> DataFrame:
        return derive.stages(batch.withColumnRenamed("text", "content")).select(
            "conv_id", "iteration", "seq", "type", "title", "content"
        )

    return write_batches(growing, path, checkpoint, each, "update")


def live_contexts(requests: DataFrame, vectors: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Context per arriving request (query_id, repo, vector) from the static chunk store, whose vector sizes are found once."""
    dims = cut_lineage(embed.modal_dims(vectors))
    return write_batches(requests, path, checkpoint, lambda b: retrieve.context_text(flagship.hits(b, vectors, dims=dims)))


_PASSED = Row("wiki_id", "page_id", "at_ms", "seq")


class PageLock(StatefulProcessor):
    """Events of one page in order of (ts, seq): a request passes while nobody works on the page, and then holds it until a finish
    event comes or ``hold_ms`` have gone by. State: the time until which the page is held."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a call to the state costs more than many events: none is made that cannot change anything
        held = self.state.get()
        until = held[0] if held else None
        for at, seq, kind in sorted(((r.at_ms, r.seq, r.kind) for r in rows), key=lambda e: e[:2]):
            if kind == "finish":
                until = None
            elif until is None or at >= until:
                yield _PASSED(*key, at, seq)
                until = at + self.hold_ms
        if held and held[0] == until:
            return
        if held:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if until is not None:
            self.state.update((until,))
            if until > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(until)
        elif held:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()  # the hold is over
        return iter(())

    def close(self) -> None:
        pass


def in_flight(events: DataFrame, hold_ms: int, late: str = "10 minutes") -> DataFrame:
    """(wiki_id, page_id, at_ms, seq) of the requests that pass. ``events``: ts, seq, wiki_id, page_id and ``kind``, request or finish.

    A page that is finished can be asked for again at once; one whose worker died, after ``hold_ms``. ``seq`` orders events of
    one time. Events may be up to ``late`` behind; state is kept for pages that are held only."""
    timed = events.withWatermark("ts", late).select(
        "ts", F.unix_millis("ts").alias("at_ms"), "seq", "wiki_id", "page_id", "kind"
    )
    schema = f"wiki_id {timed.schema['wiki_id'].dataType.simpleString()}, page_id string, at_ms bigint, seq bigint"
    return timed.groupBy("wiki_id", "page_id").transformWithState(
        statefulProcessor=PageLock(hold_ms), outputStructType=schema, outputMode="append", timeMode="eventTime"
    )


def in_flight_once(requests: DataFrame, hold: str = "1 hour") -> DataFrame:
    """First request per page while it is in work; ``ts`` is the request time, ``hold`` bounds the state."""
    return requests.withWatermark("ts", hold).dropDuplicatesWithinWatermark(["wiki_id", "page_id"])


def live_answers(prompts: DataFrame, make_generator, path: str, checkpoint: str) -> StreamingQuery:
    """Answer per prompt; a failing call becomes a row with ``error`` and the stream goes on."""
    out = generate.generate(prompts, make_generator)
    shown = generate.reply_or_message(F.col("response"), F.col("error"))
    return write_batches(out.withColumn("shown", shown), path, checkpoint)
