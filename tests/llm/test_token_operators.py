"""Alignment, collocations and token counts against plain models; odd, empty, null, repeated and very long texts."""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd import documents
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from edgelog.llm import alignment, collocations, token_counts

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "a", "B", "é", "é", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\xa0", "　", "'s", "'re", ".", ",%", "_", "7", "٣", "字", "Σ",
    "<|endoftext|>", "the", " the", "Ware", "​", "½", "-", "\x00", "\x01", "aaaa", "...", "▁", "<s>", "ﬁ", "́", "é,", "×", "\x85",
]


def odd_texts(n: int) -> list[str | None]:
    draw = random.Random(1)
    texts: list[str | None] = ["".join(draw.choices(ODD, k=draw.randint(0, 14))) for _ in range(n)]
    return [*texts, "x" * 9000, "".join(draw.choices("abcdef", k=5000)), "", None, "the of " * 300, " lead", "tail "]


# --- token counts ---------------------------------------------------------------------------------


def test_token_counts(spark, odd, odd_rows):
    whole = Tokenizer.from_file(BYTE)
    rows = [*odd_rows, *enumerate(odd_texts(400), 5000), (5000, "again"), (None, "no id")]
    found = token_counts.token_counts(documents(spark, rows), BYTE).collect()
    expected = []
    for doc_id, text in rows:
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 512))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert token_counts.token_counts(documents(spark, []), BYTE).collect() == []


def test_long_sequences_equal_rounds():
    merges, draw = token_counts.Merges(BYTE), random.Random(2)
    for text in ["x" * 700, "".join(draw.choices("abcdef", k=900)), "é" * 300, "a"]:
        data = text.encode()
        rounds = merges.survivors(np.frombuffer(data, np.uint8), np.array([len(data)]))
        assert rounds.tolist() == [merges.survivors_of_long(data)]


def test_vocabularies_that_cannot_be_merged_at_once_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="at once"):
        token_counts.Merges(str(tmp_path / "other.json"))


# --- alignment ------------------------------------------------------------------------------------


def aligned(rows: list[tuple]) -> list[tuple]:
    """By definition, from the libraries' ids of whole texts and all pairs of tokens."""
    a_of, b_of = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_of.encode_special_tokens = True
    letters = token_counts.byte_of_letter()
    name = {i: t for t, i in json.load(open(BYTE, encoding="utf-8"))["model"]["vocab"].items()}
    counts, found = Counter(), []
    for doc_id, text in rows:
        found.append(None)
        if not text:
            continue
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        of_a = [bytes(letters[c] for c in name[i]) for i in a]
        of_b = [
            bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            continue
        ends_a, ends_b = (np.cumsum([len(t) for t in of]).tolist() for of in (of_a, of_b))
        groups, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            own = (",".join(str(i) for i, e in zip(ids, ends) if last < e <= end) for ids, ends in ((a, ends_a), (b, ends_b)))
            groups.append("|".join(own))
            last = end
        links = [
            (x, y)
            for x, e, s in zip(a, ends_a, of_a)
            for y, f, t in zip(b, ends_b, of_b)
            if max(e - len(s), f - len(t)) < min(e, f)
        ]
        counts.update(links)
        found[-1] = (len(a), len(b), len(groups), links, ";".join(groups))
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc_id, _), f in zip(rows, found):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[3]
            n_best = sum(counts[p] == best[p[1]] for p in links)
            out.append((doc_id, *f[:3], len(links), n_best, sum(counts[p] for p in links), f[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 2_000])
def test_alignment(spark, slice_bytes):
    rows = [*enumerate(odd_texts(300)), (3, "the same id"), (None, "no id, the"), (None, "no id, the")]
    found = alignment.align_documents(documents(spark, rows), BYTE, PIECE, slice_bytes=slice_bytes).collect()
    assert sorted(map(tuple, found), key=repr) == aligned(rows)


def test_alignment_of_nothing(spark):
    assert alignment.align_documents(documents(spark, []), BYTE, PIECE).collect() == []
    found = alignment.align_documents(documents(spark, [(1, None), (2, "")]), BYTE, PIECE, digest=True).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_gallop():
    draw = np.random.default_rng(4)
    for _ in range(200):
        long = np.unique(draw.integers(0, 300, draw.integers(0, 90)))
        short = np.unique(draw.integers(0, 300, 20))
        low = draw.integers(0, len(long) + 1, len(short))
        high = np.maximum(low, draw.integers(0, len(long) + 1, len(short)))
        less, equal = alignment.gallop(short, long, low, high)
        for x, a, b, n, same in zip(short, low, high, less, equal):
            assert (n, same) == ((long[a:b] < x).sum(), x in long[a:b])


# --- collocations ---------------------------------------------------------------------------------


def ranked(docs: list[tuple], least: int, most: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {
        (lang, p[i : i + k])
        for (lang, p), a in candidates.items()
        for k in range(2, len(p))
        for i in range(len(p) - k + 1)
        if a >= candidates[lang, p[i : i + k]]
    }
    rows = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            cut = [(f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, k = min((1000 * a * n[lang] // (x * y), k) for k, (x, y) in enumerate(cut))
            rows.append((lang, -score, -a, " ".join(p).encode(), *cut[k], n[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, x, y, words in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, x, y, words, -score))
    return out


def languages(spark, docs: list[tuple]):
    rows = [(i % 50, t, lang, "clash", 1, "clash") for i, (lang, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, code string, n int, phrase string").repartition(3)


@pytest.mark.parametrize("bounds", [{}, {"slice_bytes": 2_000, "block_words": 7, "trie_phrases": 20}])
def test_collocations(spark, bounds):
    draw = random.Random(5)
    words = ["the", "of", "a", "Über", "x", "y", "zz", "q1", "--", "É", "w" * 3000]
    gaps = [" ", "  ", "\t", ". ", "\n", " ", ",", " ", "\x0b", "\xa0"]
    docs = [
        (draw.choice(["en", "de", None, "und"]), "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(0, 60))))
        for _ in range(300)
    ]
    docs += [("en", None), ("en", ""), ("fr", "... ,,"), ("fr", "new york city hall rocks " * 40)]
    found = collocations.collocations(languages(spark, docs), 5, 5, 60, **bounds).collect()
    assert sorted(map(tuple, found)) == ranked(docs, 5, 5, 60)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(languages(spark, [])).collect() == []
    assert collocations.collocations(languages(spark, [("en", "rare words"), (None, None)])).collect() == []


def test_scores_beyond_64_bits(spark):
    a, n, x, y = 10**12, 10**14, 7 * 10**11, 10**13 + 1
    row = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long").select(collocations.exact_score()).first()
    assert row[0] == 1000 * a * n // (x * y)


def test_trie():
    draw = random.Random(6)
    phrases = sorted({tuple(draw.choices([1, 2, 3, 50, 1000, 10**6], k=draw.randint(1, 5))) for _ in range(600)})
    table = np.array([p + (0,) * (5 - len(p)) for p in phrases])
    trie = collocations.Trie(table)
    codes = np.array(draw.choices([0, 1, 2, 3, 50, 1000, 10**6, 77], k=3000))
    found = Counter()
    for k, (positions, states) in enumerate(trie.levels(codes, 5), 1):
        for at, phrase in zip(positions.tolist(), trie.accepts[states].tolist()):
            if phrase >= 0:
                assert phrases[phrase] == tuple(codes[at : at + k].tolist())
                found[phrases[phrase]] += 1
    expected = Counter(tuple(codes[i : i + k].tolist()) for k in range(1, 6) for i in range(len(codes) - k + 1))
    assert found == {p: expected[p] for p in phrases if expected[p]}


def test_words_and_pieces():
    words, of, opens = collocations.split_words(pa.array(["A b,c", "", " .x ", "d"]))
    assert words.to_pylist() == [b"a", b"b", b"c", b"x", b"d"]
    assert of.tolist() == [0, 0, 0, 2, 3] and opens.tolist() == [True, False, True, True, True]
