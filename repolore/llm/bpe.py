"""Byte-pair vocabularies in tasks: pieces of a text, exact token counts of every prefix, and token ids.

A text is cut at its spaces. Where no other white space touches a space or an end of the text, each such element, with the
space before it, is tokenised by itself; otherwise the text is cut into *units* (white space and what follows it). Both
cuts fall where the vocabulary's own pattern cuts, so elements can be worked out once and kept.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from tokenizers import Tokenizer

SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern that byte-level vocabularies of this kind are defined by (fixed value).
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
UNITS = rf"(?:[{SPACE}]*(?! )[{SPACE}])?'(?:s|t|re|ve|m|ll|d)|[{SPACE}]*(?:\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+)|[{SPACE}]+"
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
#: Contractions of two letters, which their first letter alone does not form.
HEAD = 3  # states of a piece are kept at multiples of so many bytes, for the next piece that starts alike
CUT_SHORT = frozenset(("'re", "'ve", "'ll"))
TOUCHING = rf" [{SPACE}]|[{SPACE}] |^[{SPACE}]|[{SPACE}]$"


#: Characters of white space in one run from which the pattern's engine may give up.
LONG_GAP = 50_000
_LONG_GAP = regex.compile(rf"[{SPACE}]{{{LONG_GAP},}}")


def between_long_gaps(text: str, special: tuple[str, ...] = ()):
    """(stretch, whether it is one piece) of a text: a long run of white space is a piece, less its last character if text follows.

    The pattern cuts there as well, so the ids of the stretches, one after another, are those of the text.
    """
    at = 0
    for m in _LONG_GAP.finditer(text) if len(text) >= LONG_GAP else ():
        end = m.end() if m.end() == len(text) or text.startswith(special, m.end()) else m.end() - 1
        if m.start() > at:
            yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    if at < len(text) or not text:
        yield text[at:], False


class Kept(dict):
    """Values by element, worked out on first use; forgets all when ``limit`` is reached (it is refilled as needed)."""

    def __init__(self, make, limit: int = 1_200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """Prefix dynamic programming over a byte-level BPE file (``.json`` of the tokenizers library).

    ``last[i]`` is the last token of the encoding of the first ``i`` bytes of a piece. It is the one token that ends at ``i``,
    encodes to itself and may follow ``last[i - length]``: two tokens may follow each other when their joined bytes encode
    to just these two. Then ``count[i] = count[i - length] + 1``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_alphabet()
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special_ids}
        self.name_of = {i: t for t, i in spec["model"]["vocab"].items()}
        self.merge = Tokenizer.from_file(path).model.tokenize  # merges by rank; used on pairs of tokens only
        self.longest = max(map(len, self.ids))
        if self.longest > 128:
            raise ValueError("a token of more than 128 bytes: steps between prefix counts would not fit")
        self.pieces, self.units, self.touching = (regex.compile(x) for x in (PIECES, UNITS, TOUCHING))
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.follows: dict[int, bool] = {}
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                lengths.setdefault(t[-3:], set()).add(len(t))
        #: lengths of the tokens of three bytes and more, longest first, by their last three bytes
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in lengths.items()}
        self.heads = Kept(self._state, 200_000)
        self.elements = Kept(lambda e: self.steps(" " + e))
        self.whole = Kept(self.steps, 200_000)

    def may_follow(self, before: int, token: int) -> bool:
        pair = [x for x in (before, token) if x >= 0]
        if len(self.follows) > 1_500_000:
            self.follows.clear()
        encoded = self.merge("".join([self.name_of[x] for x in pair]))
        ok = self.follows[before << 20 | token] = [x.id for x in encoded] == pair
        return ok

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of every prefix of one piece, by bytes, from 0."""
        return self._state(piece)[1]

    def _state(self, piece: bytes) -> tuple[list[int], list[int]]:
        """(last, count) of a piece, continued from the kept state of its beginning."""
        known = (len(piece) - 1) // HEAD * HEAD
        if known <= 0:
            return self._extend(piece, [-1], [0])
        if known > 64 * HEAD:  # a very long piece goes on from a beginning of bounded depth
            known = 64 * HEAD
        last, count = self.heads[piece[:known]]
        return self._extend(piece, last.copy(), count.copy())

    def _extend(self, piece: bytes, last: list[int], count: list[int]) -> tuple[list[int], list[int]]:
        get, follows, lengths = self.ids.get, self.follows.get, self.lengths.get
        for i in range(len(last), len(piece) + 1):
            for size in lengths(piece[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                j = i - size
                if j < 0:
                    continue
                token = get(piece[j:i])
                if token is not None:
                    ok = follows(last[j] << 20 | token)
                    if ok or ok is None and self.may_follow(last[j], token):
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last, count

    def _by_char(self, piece: str) -> list[int]:
        """prefix_counts at the ends of characters, without the 0."""
        counts = self.prefix_counts(piece.encode("utf-8", "surrogatepass"))
        if len(counts) == len(piece) + 1:
            return counts[1:]
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
        return [counts[e] for e in ends]

    def steps(self, text: str) -> bytes:
        """Change of the token count at each character of a unit, as signed bytes. Their sum is the unit's count.

        A prefix that ends in white space holds all of it as one piece; a contraction cut short is an apostrophe and a letter.
        """
        if text[1:].isalpha() and text[0] == " ":  # most elements
            counts = self._by_char(text)
            return bytes([(x - y) & 255 for x, y in zip(counts, [0, *counts], strict=False)])
        if text[0:1] == " " and text[-1] in ".,;:!?" and text[1:-1].isalpha():  # and most others
            return self.elements[text[1:-1]] + b"\1"
        out, base, run, run_base = [], 0, "", 0
        for piece in self.pieces.findall(text):
            counts = self._by_char(piece)
            settled = base + counts[-1]
            if piece in CUT_SHORT:
                counts[1] = 2
            if piece[-1] in WHITE:
                if not run:
                    run_base = base
                run += piece
                if run != piece:
                    counts = [run_base - base + x for x in self._by_char(run)[-len(piece) :]]
            elif run:
                if piece[0] == " ":
                    counts[0] = run_base - base + self._by_char(run + " ")[-1]
                run = ""
            out += [base + x for x in counts] if base else counts
            base = settled
        return bytes([(x - y) & 255 for x, y in zip(out, [0, *out], strict=False)]) if out else b""

    def text_steps(self, text: str) -> bytes:
        """``steps`` of a whole text; a special string counts one token, at its last character."""
        if self.splitter is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.splitter.split(text)):
            out.append(bytes(len(part) - 1) + b"\1" if i % 2 else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.touching.search(text):
            return b"".join(map(self.whole.__getitem__, self.units.findall(text)))
        first, *rest = text.split(" ")
        return self.steps(first) + b"".join(map(self.elements.__getitem__, rest))


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in such files: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
