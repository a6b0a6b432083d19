"""Ids from remembered parts against those of whole texts."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edgelog.llm.tokens import Encoder

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {n: Encoder(public_tokenizers.path(n)) for n in NAMES}
WHOLE = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
ODD = st.sampled_from(
    ["a", "B", "é", "é", "́", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\xa0", "　", "'s", "'", ".", ",%", "_",
     "7", "٣", "字", "Σ", "ΑΣ", "ß", "İ", "<|endoftext|>", "<|startoftext|>", "the", "Ware", "​", "½", "-", "\x00", "\x01", "\u0301", "é,", "e.", "?!", "×", "÷,", "…", "a:", "\x01.", "\u2028", "\x85"]
)


def encoded(name: str, texts: list[str]) -> list[list[int]]:
    ids, counts = ENCODERS[name].encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def check(name: str, texts: list[str]) -> None:
    expected = [e.ids for e in WHOLE[name].encode_batch(texts, add_special_tokens=False)]
    assert encoded(name, texts) == expected


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=1000, deadline=None)
@given(st.lists(ODD, max_size=12).map("".join))
def test_odd_texts(name, text):
    check(name, [text, text + " x", "x " + text])


@pytest.mark.parametrize("name", NAMES)
def test_long_and_empty(name):
    check(name, ["", " ", "x" * 5_000, "word " * 3_000 + "end.\nNext, line", "a" * 300 + " b " + "a" * 300])


def test_memory_is_bounded_and_other_patterns_are_refused(tmp_path):
    small = Encoder(public_tokenizers.path(NAMES[0]), memory=2_000)
    texts = [f"w{i} w{i} x{i % 7} w{i}." for i in range(300)]
    for k in range(0, 300, 30):
        ids, _ = small.encode(pa.array(texts[k : k + 30]))
        assert ids.tolist() == [i for e in WHOLE[NAMES[0]].encode_batch(texts[k : k + 30]) for i in e.ids]
        assert small.used <= 2_000
    other = json.loads(WHOLE[NAMES[0]].to_str())
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="another pattern"):
        Encoder(str(tmp_path / "other.json"))
