"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

The distinct parts of many texts are cut into pre-tokens, and all pre-tokens lie in one ragged array of symbols. In
every round each sequence's pair of lowest rank is merged at all of its places at once; sequences without a
mergeable pair leave the array, and their surviving symbols are their tokens. A part is merged once for a slice of
texts, however often it occurs in it.

Merging all places of a pair at once equals merging one after the other if a merge's result only takes part in merges
of higher rank; a vocabulary for which this does not hold is refused, as is one with another pre-tokenizer. A
pre-token of over ``LONG`` bytes is merged with a heap of pairs, since rounds over it would take quadratic time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from edgelog.llm.shared import buffers, slices, texts_of
from edgelog.llm.tokens import TEXT_BYTES, cut_parts, ragged

LIMIT = 512
LONG = 4096

#: Fixed value: the pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int32).max
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def byte_of_letter() -> dict[str, int]:
    """The bytes for which a byte-level vocabulary's letters stand: printable ones for themselves, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """A vocabulary's merges; symbols are bytes (0 to 255) and 256 + rank of the merge that made them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        if (
            model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space")
            or not cutter.get("use_regex") or spec["normalizer"] or model.get("end_of_word_suffix")
            or model.get("continuing_subword_prefix") or model.get("ignore_merges")
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")) or any(
            set(t["content"]) & set(" \n.,;:!?%&#") for t in added
        ):
            raise ValueError(f"{path} has added tokens that take part of what is beside them")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        symbols: dict[str, int] = byte_of_letter()
        self.size = 256 + len(model["merges"])
        keys, made = np.zeros(len(model["merges"]), np.int64), set()
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a not in symbols or b not in symbols or a + b in made:
                raise ValueError(f"{path}: merge {rank} cannot be applied to all places at once")
            keys[rank] = symbols[a] * self.size + symbols[b]
            symbols[a + b] = 256 + rank
            made.add(a + b)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.of_bytes = self._look(np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)).reshape(256, 256)
        self.pieces = regex.compile(PATTERN)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where there is no merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else 0
        if not len(self.keys):
            return np.full(len(key), _NONE, np.int32)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def survivors(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols each sequence of bytes (joined in ``data``) ends with."""
        out = np.zeros(len(lengths), np.int64)
        own = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        symbol = data.astype(np.int32)
        rank = np.full(len(symbol), _NONE, np.int32)
        if len(symbol) > 1:
            rank[:-1] = np.where(own[:-1] == own[1:], self.of_bytes[data[:-1], data[1:]], _NONE)
        while len(symbol):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            size = np.diff(first, append=len(own))
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            out[own[first[done]]] = size[done]
            least = np.repeat(least, size)
            hit = np.flatnonzero((rank == least) & (least != _NONE))
            new = np.diff(hit, prepend=-2) != 1  # of neighbouring places of one pair every other is merged
            begin = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbol[hit] = 256 + rank[hit]
            stays = least != _NONE
            stays[hit + 1] = False
            place = np.cumsum(stays) - 1
            hit = place[hit]
            symbol, own, rank = symbol[stays], own[stays], rank[stays]
            for at in (hit, hit[hit > 0] - 1):
                after = np.minimum(at + 1, len(own) - 1)
                pair = (after > at) & (own[at] == own[after])
                rank[at] = np.where(pair, self._look(symbol[at], symbol[after]), _NONE)
        return out

    def survivors_of_long(self, data: bytes) -> int:
        """The same for one long sequence, with a heap of (rank, place)."""
        symbol = np.frombuffer(data, np.uint8).astype(np.int64).tolist()
        after, before, left = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1)), len(symbol)
        rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        heap = []

        def see(i: int) -> None:
            if i >= 0 and after[i] < len(symbol):
                pair = (symbol[i], symbol[after[i]])
                if (rank := rank_of.get(pair[0] * self.size + pair[1])) is not None:
                    heapq.heappush(heap, (rank, i, pair))

        for i in range(len(symbol)):
            see(i)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != pair[0] or j >= len(symbol) or symbol[j] != pair[1]:
                continue
            symbol[i], symbol[j], after[i], left = 256 + rank, -1, after[j], left - 1
            if after[i] < len(symbol):
                before[after[i]] = i
            see(before[i])
            see(i)
        return left

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every text of a string column without nulls."""
        data, offsets = buffers(column)
        at = cut_parts(data, offsets, finer=True)
        if not len(at):
            return np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
        bounds = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        tokens = self._of_parts(coded.dictionary)
        ends = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy()])])
        return np.diff(offsets), np.diff(ends[np.searchsorted(at, offsets)])

    def _of_parts(self, parts: pa.LargeBinaryArray) -> np.ndarray:
        """Tokens of each distinct part. One that is a blank or none and Latin letters is a pre-token as it is."""
        _, offsets, data = parts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        starts, lengths = bounds[:-1], np.diff(bounds)
        follows, leads = np.append(data[1:], 0), np.append(0, data[:-1])
        second = (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
        word = _LETTER[data] | ((leads == 0xC3) & second)
        word |= (data == 0xC3) & (follows >= 0x80) & (follows != 0x97) & (follows != 0xB7)
        word[starts] |= data[starts] == 0x20
        simple = (np.add.reduceat(word.astype(np.int64), starts) == lengths) & (lengths <= LONG)
        simple &= (lengths > 1) | (data[starts] != 0x20)
        out = np.zeros(len(parts), np.int64)
        extra, owner = [], []
        for i in np.flatnonzero(~simple).tolist():
            text = data[bounds[i] : bounds[i + 1]].tobytes().decode()
            for k, piece in enumerate(self.special.split(text) if self.special else [text]):
                out[i] += k > 0  # a special token before it
                for token in self.pieces.findall(piece):
                    token = token.encode()
                    if len(token) > LONG:
                        out[i] += self.survivors_of_long(token)
                    else:
                        extra.append(token)
                        owner.append(i)
        own = np.flatnonzero(simple)
        rest = np.array([len(t) for t in extra], np.int64)
        joined = np.concatenate([data[ragged(starts[own], lengths[own])], np.frombuffer(b"".join(extra), np.uint8)])
        found = self.survivors(joined, np.concatenate([lengths[own], rest]))
        out[own] += found[: len(own)]
        np.add.at(out, np.array(owner, np.int64), found[len(own) :])
        return out


_MERGES: dict[str, Merges] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) for every row of ``docs``.

    ``tokenizer`` is the file of a byte-level BPE vocabulary. Counts are those of the tokenizers library without
    tokens at beginning and end; strings of special tokens inside texts are one token. Null and empty texts have 0 bytes and
    tokens; repeated rows and rows without an id are counted as they are; other columns are not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _MERGES.get(tokenizer) or _MERGES.setdefault(tokenizer, Merges(tokenizer))
        for batch in slices(batches, TEXT_BYTES):
            sizes, tokens = merges.count(batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
