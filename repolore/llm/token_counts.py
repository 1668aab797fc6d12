"""Exact token counts of whole texts and of all their prefixes.

``prefix_table`` stores, per text, the change of the token count at every character (one signed byte each; see ``bpe``).
Truncation and budget questions are then sums over stored bytes: ``tokens_at``, ``longest_prefix``, ``budget_cuts``.

A null text counts as empty (no tokens). Repeated rows, null ids and other columns pass through or are ignored; a text of any
length is handled whole, in one byte per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.llm import bpe


def tokens_at(steps: bytes, n_chars: int) -> int:
    """Token count of the first ``n_chars`` characters."""
    return int(np.frombuffer(steps, np.int8, min(n_chars, len(steps))).sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def budget_cuts(steps: bytes, budget: int) -> list[int]:
    """Ends (in characters) of the stretches that a reader with ``budget`` tokens per stretch would take, by prefix counts."""
    total = np.maximum.accumulate(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64))
    cuts, spent = [], 0
    while not cuts or cuts[-1] < len(total):
        at = int(np.searchsorted(total, spent + budget, side="right"))
        if cuts and at <= cuts[-1] or not cuts and not at:
            at = (cuts[-1] if cuts else 0) + 1  # one character alone is over the budget
        at = min(at, len(total))
        cuts.append(at)
        if at >= len(total):
            break
        spent = int(total[at - 1])
    return cuts if len(steps) else []


def _run(path: str, limit: int, store: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("kept_chars", pa.int64())]
    schema = pa.schema(fields + [("steps", pa.binary())] * store)

    def run(batches):
        vocab = bpe.vocabulary(path)
        for batch in batches:
            tokens, kept, all_steps = [], [], []
            for text in batch.column("text").to_pylist():
                steps = vocab.text_steps(text)
                tokens.append(int(np.frombuffer(steps, np.int8).sum(dtype=np.int64)))
                kept.append(len(steps) if tokens[-1] <= limit else longest_prefix(steps, limit))
                if store:
                    all_steps.append(steps)
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": batch.column("n_bytes"), "n_tokens": tokens, "kept_chars": kept, "steps": all_steps}
            yield A.rows(schema, out)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return A.with_text(docs, "doc_id").withColumn("n_bytes", F.octet_length("text").cast("long"))


def prefix_table(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, kept_chars, steps`` per row; ``kept_chars``: longest prefix of at most ``limit`` tokens."""
    return _texts(docs).mapInArrow(_run(vocabulary, limit, True), "doc_id long, n_bytes long, n_tokens long, kept_chars long, steps binary")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """As ``prefix_table`` without the stored steps, and ``over_limit``."""
    out = _texts(docs).mapInArrow(_run(vocabulary, limit, False), "doc_id long, n_bytes long, n_tokens long, kept_chars long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
