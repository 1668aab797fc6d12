"""Texts without runs of white space are read by a pattern that does not look ahead, and get the same ids."""

import random

import numpy as np
import public_tokenizers

from repolore.llm import token_shards as T


def test_ids_are_those_of_the_whole_pattern():
    enc = T.ids(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    bits = [" ", " ", "\n", "\t", "　", "\xa0", "a", "Word", "é", "'s", "'", "12", "½", "日本", "!?", "🙂", "́", "\x1c", "don't"]
    texts = ["", " ", "\n", " a", "a ", "a \n b", "a  ", "\x1c\x1d x"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3_000)]
    for text in texts:
        assert np.frombuffer(enc.of(text), "<u2").tolist() == enc.encoding.encode_ordinary(text), text
        assert enc.count(text) == len(enc.encoding.encode_ordinary(text))


def test_only_runs_of_white_space_need_to_look_ahead(monkeypatch):
    enc = T.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ahead = []
    monkeypatch.setattr(enc, "ranks", lambda x: ahead.append(x) or enc.encoding.encode_ordinary(x))
    enc.of("one line\nand another. It's 5 o'clock")
    assert not ahead and "(?!" not in T.SINGLE
    enc.of("two\n\nparagraphs")
    assert ahead == ["two\n\nparagraphs"]
