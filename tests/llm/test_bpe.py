"""Ids and decoded texts against the public library, on edges and on random texts."""

import random

import pytest
from tokenizers import Tokenizer

from maskwright.llm import op5_bpe

OWN, LIBRARY = op5_bpe.tokenizer(op5_bpe.vocabulary_path()), Tokenizer.from_file(op5_bpe.vocabulary_path())
EDGES = [
    "", " ", "a", "I\u0301'M it's DON'T we'll 'd''s", "na\u00efve \u00c5ngstr\u00f6m \u01c5 \u0130stanbul stra\u00dfe \u1e9e", "\u00b2\u00bd \u0663\u0664 \u2167 12345", "x\x1cy\x1f z\x85w\u00a0v\u2003u\u200bt", "\u6c49\u5b57 \u0e17\u0e35\u0e48 \u0915\u094d\u0937",
    "\U0001f600\U0001f468\u200d\U0001f469", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|endoftext", "x" * 5000, "ab" * 3000 + "!" * 1000, "a\0b\x7f", "\u024f\u0250", "\u0378\U0001fae8", "tab\tand\nline\r\nend",
]


def same(text):
    enc = LIBRARY.encode(text, add_special_tokens=False)
    ids, back = OWN.encode_and_decode(text)
    assert list(op5_bpe.ids_in(ids)) == enc.ids and back == LIBRARY.decode(enc.ids, skip_special_tokens=False), repr(text[:80])


@pytest.mark.parametrize("text", EDGES)
def test_edges(text):
    same(text)


def test_random_texts():
    rng = random.Random(3)
    ranges = [(0, 0x80), (0, 0x250), (0x20, 0x7f), (0x250, 0x3000), (0x4e00, 0x5000), (0xac00, 0xac80), (0x1f600, 0x1f650)]
    for _ in range(1500):
        low, high = rng.choice(ranges)
        same("".join(chr(rng.randrange(low, high)) if rng.random() < 0.8 else " " for _ in range(rng.randrange(60))))
