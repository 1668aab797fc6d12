"""Ids of texts with very long runs of white space, which the pattern's engine cannot take at once."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repolore.llm import packing, token_shards

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [" " * 1_200_000 + "x", "a\n\t " * 3 + "\n \t" * 400_000 + "y z", "a " * 100 + " " * 1_100_000, "b" + "　" * 60_000 + "." + "\n" * 60_000, " " * 50_000 + "<|endoftext|>" + " " * 70_000 + "'s"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_ids_equal_the_library(text):
    tok = Tokenizer.from_file(JSON)
    assert packing.ids(JSON, RANKS).of(text).tolist() == tok.encode(text, add_special_tokens=False).ids
    tok.encode_special_tokens = True
    assert list(token_shards.ids(RANKS)._ids(text)) == tok.encode(text, add_special_tokens=False).ids
