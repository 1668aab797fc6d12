"""Streamed answers: event lines and text deltas put back together per response.

``segments`` keeps the positions seen in a block and emits what a micro-batch adds as runs of neighbouring positions, so
rows may come late, in other files or partitions, and only true repeats are dropped. ``growing_text`` keeps the parts of one
answer. ``parse_chunks`` reads lines that may run on from chunk to chunk, so a chunk that comes early waits in the state until the
ones before it are there; a gap that stays open becomes an ``error`` row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELTA_SCHEMA = "response_id bigint, seq bigint, line bigint, delta string"
LINE_SCHEMA = DELTA_SCHEMA + ", error string"
SEGMENT_SCHEMA = "response_id bigint, from_seq bigint, to_seq bigint, text string"
BLOCK = 4_096


def event_text(line: str) -> str | None:
    """Text of one event line; None for comments, blanks and broken JSON."""
    line = line.strip()
    if not line.startswith("data: "):
        return None
    try:
        choice = json.loads(line[6:])["choices"][0]
        return (choice.get("delta") or {}).get("content") or choice.get("text")
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None


#: Waiting rows that are read at once, for each row that comes.
AT_ONCE = 8
_LINE = Row("response_id", "seq", "line", "delta", "error")


class Early:
    """Texts by position that came before their turn, over a map state; for one call, with few calls to the state.

    All that waits is read at once while it is no more than ``AT_ONCE`` times what comes, else looked up one by one. What comes and goes within the
    call is never written."""

    def __init__(self, state, waiting: int, coming: int):
        self.state, self.waiting, self.new, self.gone = state, waiting, {}, []
        self.known = None
        if waiting <= AT_ONCE * coming:
            self.known = {k[0]: v[0] for k, v in state.iterator()} if waiting else {}

    def __contains__(self, seq: int) -> bool:
        return seq in self.new or (seq in self.known if self.known is not None else self.state.containsKey((seq,)))

    def put(self, seq: int, text: str | None) -> None:
        if seq not in self:
            self.new[seq] = text
            self.waiting += 1

    def take(self, seq: int) -> str | None:
        self.waiting -= 1
        if seq in self.new:
            return self.new.pop(seq)
        self.gone.append(seq)
        return self.known.pop(seq) if self.known is not None else self.state.getValue((seq,))[0]

    def first(self) -> int:
        return min([*self.new, *(self.known if self.known is not None else (k[0] for k in self.state.keys()))])

    def forget(self) -> None:
        self.state.clear()
        self.waiting, self.new, self.gone = 0, {}, []

    def write(self) -> None:
        if self.gone and self.waiting == len(self.new):
            self.state.clear()
        else:
            for seq in self.gone:
                self.state.removeKey((seq,))
        for seq, text in self.new.items():
            self.state.updateValue((seq,), (text,))


class LineParser(StatefulProcessor):
    """Raw chunks (response_id, seq, data), numbered from ``first`` without holes, to deltas at (seq, line).

    Chunks may come in any order, file and micro-batch; a line may be split over any of them. State: the next chunk expected, the
    unfinished line, and the chunks that came early. With ``gap_ms``, a chunk that others have waited for that long is given up: its
    error row names the chunks that are missing, and reading goes on behind the first line end after them. Repeats are
    dropped. After the end mark nothing is kept but the mark.
    """

    def __init__(self, ttl_ms: int | None = None, gap_ms: int | None = None, first: int = 0):
        self.ttl_ms, self.gap_ms, self.first = ttl_ms, gap_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("line", "next bigint, rest string, torn boolean, done boolean, waiting bigint", self.ttl_ms)
        self.waits = handle.getMapState("early", "seq bigint", "data string", self.ttl_ms)

    def _load(self, coming: int | None = None) -> None:
        self.next, self.rest, self.torn, self.done, waiting = self.state.get() or (self.first, "", False, False, 0)
        self.early = Early(self.waits, waiting, waiting if coming is None else coming)

    def _read(self, data: str | None) -> list[tuple[int, str]]:
        """(line number, text) of the lines that the next chunk ends."""
        seq, out = self.next, []
        *lines, self.rest = (self.rest + (data or "")).split("\n")
        if self.torn and lines:  # the first line end after a gap ends a line whose beginning is lost
            lines, self.torn = [None, *lines[1:]], False
        for i, line in enumerate(lines):
            if line is not None and not self.done:
                self.done = line.strip() == "data: [DONE]"
                text = None if self.done else event_text(line)
                if text:
                    out.append((seq, i, text))
        self.next += 1
        return out

    def _drain(self) -> list[tuple[int, str]]:
        """Lines of the early chunks whose turn has come."""
        out = []
        while self.early.waiting and not self.done and self.next in self.early:
            out += self._read(self.early.take(self.next))
        return out

    def _save(self, now: int) -> None:
        if self.done and self.early.waiting:
            self.early.forget()
        self.early.write()
        waiting = self.early.waiting
        if self.gap_ms:
            timers = list(self.handle.listTimers())
            if waiting and not timers:
                self.handle.registerTimer(now + self.gap_ms)
            elif not waiting:
                for t in timers:
                    self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.state.update((self.next, "" if self.done else self.rest, self.torn, self.done, waiting))

    def _rows(self, key, found, error: tuple[int, str] | None = None) -> Iterator[Row]:
        if error:
            yield _LINE(key[0], error[0], -1, None, error[1])
        for seq, i, text in found:
            yield _LINE(key[0], seq, i, text, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        chunks, out = _by_seq(rows, "data"), []
        self._load(len(chunks))
        for seq, data in sorted(chunks.items(), key=lambda c: c[0]):
            if seq >= self.next:  # the same chunk may wait already
                out += self._drain()
            if self.done or seq < self.next:
                continue
            if seq == self.next:
                out += self._read(data)
            else:
                self.early.put(seq, data)
        out += self._drain()
        self._save(timerValues.getCurrentProcessingTimeInMs() if self.gap_ms else 0)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        if not self.early.waiting:
            return
        missing = self.next
        self.next = self.early.first()
        self.rest, self.torn = "", True
        why = f"chunks {missing} to {self.next - 1} did not come"
        out = self._drain()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self._save(timerValues.getCurrentProcessingTimeInMs())
        yield from self._rows(key, out, (missing, why))

    def close(self) -> None:
        pass


def _by_seq(rows: Iterator[Row], text: str) -> dict[int, str | None]:
    """Texts of a micro-batch by position; of repeats the first."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["seq"], r[text])
    return out


def _unseen(rows: Iterator[pd.DataFrame], seen: set[int]) -> pd.DataFrame:
    """This micro-batch's rows at positions not seen before, by ``seq``."""
    pdf = pd.concat(list(rows), ignore_index=True)
    return pdf[~pdf["seq"].isin(seen)].drop_duplicates("seq").sort_values("seq", kind="stable")


class SegmentBuilder(StatefulProcessor):
    """Deltas to segments of neighbouring positions. State: the positions seen in one block, as bits."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "bits string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bits = int(self.state.get()[0], 16) if self.state.exists() else 0
        base = key[1] * BLOCK
        new = _unseen(rows, {base + i for i in range(bits.bit_length()) if bits >> i & 1})
        if len(new):
            for seq in new["seq"]:
                bits |= 1 << (int(seq) - base)
            self.state.update((f"{bits:x}",))
            run = (new["seq"].diff() != 1).cumsum()
            found = new.assign(delta=new["delta"].fillna("")).groupby(run).agg(
                from_seq=("seq", "min"), to_seq=("seq", "max"), text=("delta", "".join)
            )
            yield found.assign(response_id=key[0])[["response_id", "from_seq", "to_seq", "text"]].reset_index(drop=True)

    def close(self) -> None:
        pass


class GrowingText(StatefulProcessor):
    """Deltas to the text so far, in order of position. Keeps the parts of one model answer; its length is the model's limit."""

    def __init__(self, ttl_ms: int | None = None, keys: Sequence[str] = ("response_id",)):
        self.ttl_ms, self.keys = ttl_ms, tuple(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("parts", "parts string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = {int(k): v for k, v in json.loads(self.state.get()[0])} if self.state.exists() else {}
        new = _unseen(rows, set(parts))
        if len(new):
            parts |= {int(q): d for q, d in zip(new["seq"], new["delta"].fillna(""), strict=True)}
            self.state.update((json.dumps(sorted(parts.items())),))
            text = "".join(parts[q] for q in sorted(parts))
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, "seq": [max(parts)], "text": [text]})

    def close(self) -> None:
        pass


PLAN, UPDATE, CONCLUSION = "## Research Plan", "## Research Update {}", "## Final Conclusion"


class StageScanner(StatefulProcessor):
    """Deltas of one answer, numbered from 0, to runs of text with the stage that the text up to there shows.

    State: the next position, the last characters read (as many as a marker may need), which markers were met, and deltas that
    came early. A micro-batch reads and emits its own deltas only, so state and output grow with the answer, not with
    answer times batches. The last key is the iteration.
    """

    def __init__(self, ttl_ms: int | None = None, keys: Sequence[str] = ("response_id", "iteration")):
        self.ttl_ms, self.keys = ttl_ms, tuple(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scan", "next bigint, tail string, plan boolean, renewed boolean, final boolean, waiting bigint", self.ttl_ms)
        self.waits = handle.getMapState("early", "seq bigint", "delta string", self.ttl_ms)
        self.row = Row(*self.keys, "from_seq", "to_seq", "text", "type")

    @staticmethod
    def _stage(iteration: int, met: list[bool]) -> str | None:
        if iteration == 1 and met[0]:
            return "plan"
        return "update" if 1 <= iteration <= 4 and met[1] else "conclusion" if met[2] else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, tail, *met, waiting = self.state.get() or (0, "", False, False, False, 0)
        here = {q: d or "" for q, d in _by_seq(rows, "delta").items() if q >= at}
        if not here:  # repeats only
            return
        early = Early(self.waits, waiting, len(here))
        for q, delta in here.items():
            early.put(q, delta)
        iteration = int(key[-1])
        markers = [PLAN, UPDATE.format(iteration), CONCLUSION]
        keep, found = max(map(len, markers)) - 1, []
        while early.waiting and at in early:
            delta = early.take(at)
            seen = tail + delta
            met = [m or x in seen for m, x in zip(met, markers, strict=True)]
            tail, kind = seen[-keep:], self._stage(iteration, met)
            if found and found[-1][3] == kind:
                found[-1][1] = at
                found[-1][2].append(delta)
            else:
                found.append([at, at, [delta], kind])
            at += 1
        early.write()
        self.state.update((at, tail, *met, early.waiting))
        for a, b, d, kind in found:
            yield self.row(*key, a, b, "".join(d), kind)

    def close(self) -> None:
        pass


def time_mode(ttl_ms: int | None) -> str:
    """State expiry needs the clock; without it a run-to-the-end query would never see its last batch."""
    return "processingTime" if ttl_ms else "none"


def _run(stream: DataFrame, keys: list[str], processor, schema: str, mode: str, by_row: bool = False) -> DataFrame:
    """``by_row``: the processor takes and gives rows; a table for each of many small keys costs more than its rows."""
    grouped = stream.groupBy(*keys)
    run = grouped.transformWithState if by_row else grouped.transformWithStateInPandas
    return run(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time_mode(processor.ttl_ms)
    )


def parse_chunks(chunks: DataFrame, ttl_ms: int | None = None, gap_ms: int | None = None, first: int = 0) -> DataFrame:
    """(response_id, seq, line, delta, error) of chunks in any order (see ``LineParser``).

    A line may run on into the next chunk, so a response is read in one place; one model answer is its size. Without ``gap_ms``
    a chunk is waited for as long as the stream lives; ``waiting_chunks`` shows what waits."""
    parser = LineParser(ttl_ms, gap_ms, first)
    return chunks.select("response_id", "seq", "data").groupBy("response_id").transformWithState(
        statefulProcessor=parser, outputStructType=LINE_SCHEMA, outputMode="append", timeMode=time_mode(ttl_ms or gap_ms)
    )


def waiting_chunks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(response_id, seq) of chunks that a stopped ``parse_chunks`` stream with this checkpoint still holds back."""
    state = spark.read.format("statestore").option("stateVarName", "early").load(checkpoint)
    return state.select(F.col("key.response_id").alias("response_id"), F.col("user_map_key.seq").alias("seq"))


def segments(deltas: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Grouped by blocks of positions: a response with very many deltas spreads over tasks, each with at most a block.

    A block's rows may arrive in any order and micro-batch; positions seen before are repeats."""
    blocked = deltas.select("response_id", F.floor(F.col("seq") / BLOCK).alias("block"), "seq", "delta")
    return _run(blocked, ["response_id", "block"], SegmentBuilder(ttl_ms), SEGMENT_SCHEMA, "append")


def growing_text(deltas: DataFrame, ttl_ms: int | None = None, keys: Sequence[str] = ("response_id",)) -> DataFrame:
    """(keys, seq, text): the bigint columns ``keys`` name an answer; each is kept, so that no two answers share a key."""
    schema = "".join(f"{k} bigint, " for k in keys) + "seq bigint, text string"
    return _run(deltas.select(*keys, "seq", "delta"), list(keys), GrowingText(ttl_ms, keys), schema, "update")


def stage_runs(deltas: DataFrame, ttl_ms: int | None = None, keys: Sequence[str] = ("response_id", "iteration")) -> DataFrame:
    """(keys, from_seq, to_seq, text, type): every text once, in runs, each with the stage shown at its end (null: none yet).

    ``keys`` are bigint columns, the iteration last. Deltas may come in any order and micro-batch; one that comes early waits in the state."""
    schema = "".join(f"{k} bigint, " for k in keys) + "from_seq bigint, to_seq bigint, text string, type string"
    return _run(deltas.select(*keys, "seq", "delta"), list(keys), StageScanner(ttl_ms, keys), schema, "append", by_row=True)
