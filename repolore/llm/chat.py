"""Chat formatting into budgeted windows with a loss mask.

A conversation's turns are written as ``<turn role>`` + newline + text + ``</turn>`` + newline. Inside roles and texts, ``\\`` and ``<``
(and ``>`` in roles) are escaped, so no text can hold a control string, and ``unescape`` restores it.

Prefix sums of the turns' tokens choose turn-aligned windows: each starts with the system turn (the conversation's first turn, if its role is
``system``), repeats the latest earlier turns that fit ``history`` tokens, and takes new turns up to ``budget`` tokens in all. A turn that
is over the budget alone makes a window by itself, so no text is cut. The loss mask covers the texts of assistant turns that are new in
their window; repeated turns are masked out, so each target counts once.

Rows are ordered by turn, then role and text (ties); a null text is empty, a null role an empty one, a null ``conv_id`` is one conversation.
Tokens are counted before rows are dealt by conversation, so the turns of a conversation that holds a third of all rows are counted by all
tasks. Then a task streams its conversations turn by turn and holds one window: a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repolore.llm import arrays as A
from repolore.llm import bpe

_WINDOW_DDL = "conv_id long, window_no long, text string, loss array<struct<start:long,end:long>>, n_new long, n_tokens long"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_WINDOW = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int64()), ("text", pa.string()), ("loss", pa.list_(_SPAN)), ("n_new", pa.int64()), ("n_tokens", pa.int64())])
_TURN = re.compile(r"<turn ([^>]*)>\n([^<]*)</turn>\n")
_CODES = {"\\\\": "\\", "\\l": "<", "\\g": ">"}


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\l")
    return text.replace(">", "\\g") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lg]", lambda m: _CODES[m[0]], text) if "\\" in text else text


def read_turns(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of one formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


def _parts(role: str, text: str) -> tuple[str, str]:
    """Head and body of a formatted turn."""
    return f"<turn {escape(role, True)}>\n", escape(text)


def count_tokens(texts: list[str], encoder: Tokenizer, vocab: bpe.Vocabulary, long: int = 1 << 20) -> list[int]:
    """Tokens of each text; texts over ``long`` characters go by the prefix counts, which hold a byte a character and agree."""
    out = [0] * len(texts)
    short = [i for i, s in enumerate(texts) if len(s) <= long]
    for at in range(0, len(short), 256):
        part = short[at : at + 256]
        for i, found in zip(part, encoder.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = len(found)
    for i, s in enumerate(texts):
        if len(s) > long:
            out[i] = int(np.frombuffer(vocab.text_steps(s), np.int8).sum(dtype=np.int64))
    return out


def _count(vocabulary: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        vocab, encoder = bpe.vocabulary(vocabulary), Tokenizer.from_file(vocabulary)
        encoder.no_padding()
        encoder.no_truncation()
        for batch in batches:
            pairs = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            n = count_tokens(["".join((*_parts(*p), "</turn>\n")) for p in pairs], encoder, vocab)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return run


class _Writer:
    """One conversation: turns in, finished windows out."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.recent, self.recent_size = None, [], 0
        self.number, self.seen = 0, 0
        self.new: list = []
        self.size = 0

    def add(self, role: str, text: str, n_tokens: int):
        turn = (*_parts(role, text), role, n_tokens)
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        if self.new and self.size + turn[3] > self.budget:
            yield self.close()
        if not self.new:
            self._open(turn[3])
        self.new.append(turn)
        self.size += turn[3]

    def _open(self, first: int):
        """Repeat as much recent history as both limits allow."""
        self.size = self.system[3] if self.system and self.number else 0
        self.old = []
        room = min(self.history, self.budget - self.size - first)
        for turn in reversed(self.recent):
            if turn[3] > room or turn is self.system:
                break
            self.old.insert(0, turn)
            room -= turn[3]
        self.size += sum(t[3] for t in self.old)

    def close(self):
        lead = [self.system] if self.system and self.number else []
        out, spans, at = [], [], 0
        for k, (head, body, role, _) in enumerate([*lead, *self.old, *self.new]):
            at += len(head)
            if k >= len(lead) + len(self.old) and role == "assistant":
                spans.append({"start": at, "end": at + len(body)})
            at += len(body) + len("</turn>\n")
            out += (head, body, "</turn>\n")
        row = (self.conv, self.number, "".join(out), spans, len(self.new), self.size)
        self.recent = [*self.old, *self.new]
        while self.recent and sum(t[3] for t in self.recent) > self.history:
            self.recent.pop(0)
        self.new, self.number = [], self.number + 1
        return row


def _write(budget: int, history: int):
    def run(batches):
        writer, out = None, []
        pack = lambda: A.rows(_WINDOW, dict(zip(_WINDOW.names, zip(*out, strict=True), strict=True)))
        for batch in batches:
            for conv, role, text, n_tokens in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n_tokens")], strict=True):
                if writer is None or writer.conv != conv:
                    if writer is not None:
                        out.append(writer.close())
                    writer = _Writer(conv, budget, history)
                out.extend(writer.add(role, text, n_tokens))
                if len(out) >= 1000:
                    yield pack()
                    out = []
        if writer is not None:
            out.append(writer.close())
        if out:
            yield pack()

    return run


def windows(turns: DataFrame, vocabulary: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """``conv_id, window_no, text, loss, n_new, n_tokens``; a conversation's windows come in order, in one partition."""
    n = A.n_buckets(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", n_tokens long"
    rows = rows.mapInArrow(_count(vocabulary), schema)
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "n_tokens")
    return rows.mapInArrow(_write(budget, history), _WINDOW_DDL)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``windows``: counts and hashes of its new turns and of the text under the mask.

    Runs over the windows in the order and partitions in which ``windows`` gives them.
    """
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        now = None
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "n_new")]
            for conv, text, loss, n_new in zip(*cols, strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in read_turns(text)[-n_new:]:
                    now[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode("utf-8", "surrogatepass"))
                now[1] += n_new
                now[5] += len(text)
                now[6] += 1
            if out:
                yield A.rows(schema, dict(zip(schema.names, zip(*out, strict=True), strict=True)))
        if now is not None:
            last = (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])
            yield A.rows(schema, dict(zip(schema.names, [[x] for x in last], strict=True)))

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return formatted.mapInArrow(run, ddl)
