"""Packing of documents into training sequences by the online sum-of-squares rule.

A document is its token ids and an end mark. Whole sequences of ``length`` ids are cut from its front; what is left, shorter than
a sequence, is one piece and goes to a window. A level array holds how many open windows are filled to each level. A piece goes to the
level (0: a new window) for which the sum of the squared counts becomes least, the fullest of equals; so no level gathers many
windows that wait for the same missing size. A window that is filled is a sequence.

Each task packs its own part of the scan, so nothing is shuffled, and numbers its sequences from its partition's number. Windows
that stay open, at the end or when ``most_open`` wait, are closed: their pieces in order of fill make a stream that is cut
every ``length`` ids. The last stretch of a part is cut into powers of two, which need no padding, so a part pads nothing.

Null and empty texts have the end mark alone. Rows that repeat, null ids and other columns make no difference; an empty table
gives no pieces. Special strings in texts are special tokens, as the vocabulary's own library reads them. A text's ids are made
at once, whatever its length; open windows hold at most ``most_open`` * ``length`` ids.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.llm.bpe import LONG_GAP, PIECES, between_long_gaps

#: Sequences that one partition can number.
ROOM = 1 << 38
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids as the tokenizers library gives them for ``path`` (a ``.json`` file), by the ranks in the ``.tiktoken`` file beside it."""

    def __init__(self, path: str, ranks: str):
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = tuple(special)
        self.encoding = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=table, special_tokens=special)
        self.gap = tiktoken.Encoding("gaps", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if len(text) < LONG_GAP:
            return np.asarray(self.encoding.encode(text, allowed_special="all"), "<u4")
        parts = [self.gap.encode_ordinary(x) if one else self.encoding.encode(x, allowed_special="all") for x, one in between_long_gaps(text, self.special)]
        return np.concatenate([np.asarray(x, "<u4") for x in parts])


_LOADED: dict[tuple[str, str], Ids] = {}


def ids(path: str, ranks: str) -> Ids:
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = Ids(path, ranks)
    return _LOADED[path, ranks]


class Windows:
    """Windows of one part of the scan. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, length: int, most_open: int):
        self.length, self.most_open = length, most_open
        self.levels = np.zeros(length + 1, np.int64)  # open windows by fill; level 0 and the full level stay empty
        self.open: list[list[list]] = [[] for _ in range(length)]
        self.n_open = 0

    def place(self, piece: tuple) -> list | None:
        """Puts a piece into its window; the pieces of that window if it is full now."""
        size, n = len(piece[3]), self.levels
        if size == self.length:
            return [piece]
        # the sum of squares changes by 2 * (n[fill + size] - n[fill] + 1); no count is kept at 0 and at the full level
        gain = 2 * (n[size:] - n[: self.length + 1 - size]) + 2
        gain[0] = 2 * n[size] + 1
        gain[-1] = 1 - 2 * n[self.length - size]
        usable = n[: self.length + 1 - size] > 0
        usable[0] = True
        gain[~usable] = np.iinfo(np.int64).max
        fill = len(gain) - 1 - int(np.argmin(gain[::-1]))
        if fill:
            window = self.open[fill].pop()
            self.levels[fill] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if fill + size == self.length:
            return window
        self.open[fill + size].append(window)
        self.levels[fill + size] += 1
        self.n_open += 1
        return None

    def crowded(self) -> bool:
        return self.n_open >= self.most_open

    def close(self, last: bool) -> list[list]:
        """All open windows as sequences; unless it is the ``last`` time, what does not fill a sequence stays open."""
        stream = [p for level in reversed(self.open) for window in level for p in window]
        total = sum(len(p[3]) for p in stream)
        cuts = [self.length] * (total // self.length)
        rest = total % self.length
        cuts += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1] if last else [rest] * (rest > 0)
        out, at = [], iter(stream)
        piece = next(at, None)
        for size in cuts:
            window = []
            while size:
                doc, start, n, x = piece
                window.append((doc, start, n, x[:size]))
                if len(x) > size:
                    piece, size = (doc, start + size, n, x[size:]), 0
                else:
                    size -= len(x)
                    piece = next(at, None)
            out.append(window)
        self.__init__(self.length, self.most_open)
        if rest and not last:
            self.open[rest].append(out.pop())
            self.levels[rest], self.n_open = 1, 1
        return out


def _run(path: str, ranks: str, length: int, end: int, most_open: int):
    def emit(sequences, first):
        cols = [[] for _ in _OUT.names]
        for i, window in enumerate(sequences):
            offset = 0
            for doc, start, n, x in window:
                for c, v in zip(cols, (doc, start, len(x), zlib.crc32(x.tobytes()), n, first + i, offset), strict=True):
                    c.append(v)
                offset += len(x)
        return A.rows(_OUT, dict(zip(_OUT.names, cols, strict=True)))

    def run(batches):
        from pyspark import TaskContext

        enc, windows, mark = ids(path, ranks), Windows(length, most_open), np.array([end], "<u4")
        done, ready, held = TaskContext.get().partitionId() * ROOM, [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                x = np.concatenate([enc.of(text), mark])
                n = len(x)
                whole = n // length * length
                ready += [[(doc, s, n, x[s : s + length])] for s in range(0, whole, length)]
                if whole < n and (full := windows.place((doc, whole, n, x[whole:].copy()))):
                    ready.append(full)
                if windows.crowded():
                    ready += windows.close(last=False)
                held += n
                if held >= 1 << 20:  # ids
                    yield emit(ready, done)
                    done, ready, held = done + len(ready), [], 0
        yield emit(ready + windows.close(last=True), done)

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str, length: int = 2048, end: int = 1, most_open: int = 4096) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of ``docs`` (``doc_id, text``).

    ``vocabulary`` is a file of the tokenizers library and ``ranks`` the same vocabulary as ranks; ``end`` closes a document.
    """
    texts = A.with_text(docs, "doc_id").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(_run(vocabulary, ranks, length, end, most_open), _DDL)
