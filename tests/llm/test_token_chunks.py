"""Chunked ids of texts with odd white space, marks and null characters against the untouched library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from chunkwright.llm.tokens import ChunkEncoder, tokenizer_path

ODD = ["a \0b", "\0", "x \0", "İ.", "a İ, b", "T̈.", "-\r\n\xa0\tx", "a\n\nb", "\na", "a\n", "a \nb", "a\n b", " ", "  ", "a ", "one\ntwo. three", "a\tb", ".\n.", "a's\n's"]
PIECES = ["a", "Bc", "Él", " ", "  ", "\n", "\r\n", "\t", ".", "'s", " '", "23", "\0", "\x1c", "\xa0", "　", " ", "ß", "İ", "Σ", "漢字", "?!", "<|endoftext|>", "é"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_chunks(name):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(5000)]
    library = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    together, alone = ChunkEncoder(name), ChunkEncoder(name)
    as_ids = lambda packed: np.frombuffer(packed, "<u4").tolist()
    assert list(map(as_ids, together.encode(texts))) == want
    assert [as_ids(alone.encode([t])[0]) for t in texts] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_stay_when_the_cache_turns_over(name, monkeypatch):
    monkeypatch.setattr("chunkwright.llm.tokens.CACHE_CHUNKS", 20)
    library, encoder = Tokenizer.from_file(tokenizer_path(name)), ChunkEncoder(name)
    for at in range(0, 300, 7):
        texts = [f"word{at} and more words, line\nnumber {at % 50}.", "", f"w{'x' * (at % 60)}"]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
