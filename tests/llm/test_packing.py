"""Tokens word by word against the whole text, and the constraints of best fit."""

import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", "a", "It's I'LL 've", "É é İ ΣΑΣ ß ﬁ Ǆ", "a b c\x1cd\x85e\tf\r\ng", "<|endoftext|>x <|startoftext|>", "x²3½ ７ 中文字 ___--..", "'s't're", "­​ à́", "  a  \n\n b "]


def same(text):
    assert np.frombuffer(packing.encode([text], PATH)[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAzZéÉßÿİıŉǅ0²½'sTdmlLvVeErR<|>_-. \n\t ́Σς中­\x1c\x85"), max_size=30))
def test_any_text(text):
    same(text)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS", 3)
    monkeypatch.setattr(packing, "MAX_PARTS", 3)
    for text in ("one two three four five", "six, seven", "one two"):
        same(text)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_constraints(rule):
    lengths = np.sort(np.random.default_rng(1).integers(1, 101, 500))[::-1]
    at = packing.best_fit(lengths, 100, 7, 6000, (1.0, 0.05, 0.05), rule) if rule == "norm" else packing.best_fit(lengths, 100, 7, 10_000, (1.0, 1.0, 1.0), rule)
    for k in np.unique(at):
        own = lengths[at == k]
        assert own.sum() <= 100 and len(own) <= 7 and (rule == "dot" or (own.astype(float) ** 2).sum() <= 6000 or len(own) == 1)


def test_full_sequences():
    lengths = np.sort(np.random.default_rng(2).lognormal(3, 1, 2000).astype(int).clip(1, 200))[::-1]
    at = packing.best_fit(lengths, 200, 200, 40_000, (1.0, 0.05, 0.05))
    assert at.max() + 1 <= -(-lengths.sum() // 200) + 1


def test_known_parts_and_slices_are_small():
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(40_000)]
    texts = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
    encoder = packing._Encoder(PATH)
    tracemalloc.start()
    try:
        for t in texts:
            encoder.encode([t])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 100 * len(set(words))
    ids, edges = encoder.encode(texts[:3] + [None, ""])
    for t, a, b in zip([*texts[:3], "", ""], edges[:-1], edges[1:]):
        assert ids[a:b].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0]
    many = [*["a" * 100_000] * 5, None, "b" * 1_000_000, ""]
    cut = packing._slices(many)
    assert [x for a, b in cut for x in range(a, b)] == list(range(len(many))) and packing._slices([]) == []
    assert all(b - a == 1 or sum(len(t or "") for t in many[a:b]) <= packing.SLICE_CHARS for a, b in cut) and len(cut) == 5
