"""Units of the word encoder and the byte counter against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest

from tilespark.llm import tokens


def _library(tok, text):
    return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _texts():
    draw = random.Random(11)
    signs = [chr(c) for c in (*range(0x20, 0x250), 0x301, 0x4E2D, 0x1F600, 0x3A3, 0xA0, 0x85, 0x2028, 9, 10, 13)]
    texts = [f"a{c}b {c}{c} X{c}1{c}2." for c in signs]
    texts += ["".join(draw.choice(signs if draw.random() < 0.5 else "abE 1's.|<é") for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    return texts + ["", " ", "x" * 5000, "é" * 24 + " ok", "W" * 48 + ".", "W" * 49 + ". b", "a<|endoftext|>b", "1" * 60]


def test_words_equal_the_library():
    encode = tokens.WordEncoder()
    texts = _texts()
    assert encode(texts) == [_library(encode.tok, t) for t in texts]


@pytest.mark.parametrize("kept", [2, 50, 1000])
def test_forgetting_units_changes_nothing(monkeypatch, kept):
    texts = _texts()[:600] * 2
    path = public_tokenizers.path(tokens.BYTE_FILE)
    whole = tokens.prove_whole_tokens(path)
    ids, counts = tokens.WordEncoder()(texts), tokens.ByteCounter(path, whole)(texts)
    monkeypatch.setattr(tokens, "UNITS_KEPT", kept)
    small, few = tokens.WordEncoder(), tokens.ByteCounter(path, whole)
    assert [b for i in range(0, len(texts), 7) for b in small(texts[i : i + 7])] == ids
    assert [n for i in range(0, len(texts), 7) for n in few(texts[i : i + 7])] == counts
