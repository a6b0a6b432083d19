"""Tokenizing with the tokenizers library: each distinct part between blanks of many texts is encoded once.

Both tokenizers used here end a piece before a blank (or line end) that stands between two other characters, and
between a letter or digit and punctuation, so a text can be cut there; ``encode`` gives exactly the ids of the whole texts. A vocabulary that cuts texts by another
pattern is refused. Ids of parts that occur more than once are remembered, within a bound in bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from edgelog.llm.shared import buffers

#: Bytes that a Python worker may spend on remembered parts, and what one costs besides its own bytes and ids.
MEMORY_BYTES, PART_BYTES = 96 << 20, 160

#: Bytes of text that are encoded at once: the more, the fewer parts are met again.
TEXT_BYTES = 12 << 20

#: The patterns by which the supported vocabularies cut texts.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Stands between parts that are encoded in one call; always a piece of its own.
_MARK = " \x01"
_CALL_BYTES = 1 << 14

#: Bytes of which a blank's neighbours may not be the last or first: white space and control characters, and
#: the first bytes of characters of which some are white space.
_CLOSED = np.zeros(256, bool)
_CLOSED[:33] = True
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

#: Punctuation before which ``finer`` parts begin (neither apostrophes, which begin suffixes, nor parts of special
#: tokens), and ASCII letters and digits.
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?%&#")] = True
_PLAIN = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def cut_parts(data: np.ndarray, offsets: np.ndarray, finer: bool = False) -> np.ndarray:
    """Where the parts of the texts ``data[offsets[i]:offsets[i + 1]]`` begin: at their starts (of texts that are not
    empty) and at blanks that have other characters than white space on both sides; ``finer``: also at such line
    ends, and at punctuation after a letter or digit."""
    starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    blank = (data == 0x20) | (data == 0x0A) if finer else data == 0x20
    at = np.flatnonzero(blank)
    at = at[(at > 2) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    open_ = ~_CLOSED[after] & ~_WIDE_SPACE[after] & ~_CLOSED[before]
    open_ &= (before < 0x80) | ~((data[at - 2] == 0xC2) | _WIDE_SPACE[data[at - 3]])
    at = at[open_]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    at = at[~edge[at] & ~edge[at + 1]]
    if finer:
        marks = np.flatnonzero(_STOP[data])
        marks = marks[marks > 1]
        last = data[marks - 1]
        letter = (data[marks - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        marks = marks[(_PLAIN[last] | letter) & ~edge[marks]]
        at = np.concatenate([at, marks])
    return np.sort(np.concatenate([starts, at]))


def distinct_parts(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different parts, and for every part which of them it is."""
    if not len(starts):
        return [], np.zeros(0, np.int32)
    bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def inner_parts(data: np.ndarray, at: np.ndarray, offsets: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Which of the ``n`` different parts begin with a blank (or line end) before another character, and end at a cut
    somewhere, not at a text's end."""
    if not len(at):
        return np.zeros(n, bool)
    edge = np.zeros(int(offsets[-1]) + 1, bool)
    edge[offsets] = True
    inner = ~edge[np.append(at[1:], offsets[-1])]
    second = np.append(data, np.uint8(0))[at + 1]
    inner &= ((data[at] == 0x20) | (data[at] == 0x0A)) & ~_CLOSED[second] & ~_WIDE_SPACE[second]
    out = np.zeros(n, bool)
    out[which[inner]] = True
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all members of runs that begin at ``starts``."""
    total = int(lengths.sum())
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    before = np.cumsum(lengths) - lengths
    places = np.repeat((starts - before).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return places


class Encoder:
    """Texts to ids, without added special tokens."""

    def __init__(self, path: str, memory: int = MEMORY_BYTES, plain: bool = False):
        """``plain``: strings of special tokens in texts are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self._refuse_other_patterns(path)
        self.mark = self._batch([_MARK])[0]
        self.memory = memory
        self._forget()

    def _refuse_other_patterns(self, path: str) -> None:
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        by_bytes = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
        own = len(steps) == 1 and bool(steps[0].get("use_regex"))
        words = len(steps) == 2 and steps[0].get("pattern") == {"Regex": _WORD_PATTERN}
        if not by_bytes or not (own or words):
            raise ValueError(f"{path} cuts texts by another pattern; its texts cannot be encoded in parts")

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.lengths, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, parts: list[bytes], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, joined, and how many each has. ``inner`` parts, with other characters than white space
        beside their first blank and at their end, are encoded many in one call."""
        together = [i for i in np.flatnonzero(inner).tolist() if b"\x01" not in parts[i]]
        alone = np.setdiff1d(np.arange(len(parts)), together, assume_unique=True)
        found = self._batch([parts[i].decode() for i in alone.tolist()])
        lengths = [np.array([len(ids) for ids in found], np.int64)]
        sizes = np.cumsum([len(parts[i]) for i in together])
        calls = np.searchsorted(sizes, np.arange(_CALL_BYTES, sizes[-1] + _CALL_BYTES, _CALL_BYTES)) if together else []
        first = 0
        for last in (min(int(c) + 1, len(together)) for c in calls):
            if last == first:
                continue
            text = _MARK.encode().join([*(parts[i] for i in together[first:last]), b""]).decode()
            ids = self._batch([text])[0]
            ends = np.flatnonzero(ids == self.mark[-1]) + 1
            if len(ends) != last - first:
                raise ValueError("a mark between parts was not a piece of its own")
            keep = np.ones(len(ids), bool)
            for k in range(len(self.mark)):
                keep[ends - 1 - k] = False
            found.append(ids[keep])
            lengths.append(np.diff(ends, prepend=0) - len(self.mark))
            first = last
        order = np.concatenate([alone, np.array(together, np.int64)]).astype(np.int64)
        lengths, ids = np.concatenate(lengths), np.concatenate([np.zeros(0, np.uint32), *found])
        starts = np.cumsum(lengths) - lengths
        back = np.argsort(order)
        return ids[ragged(starts[back], lengths[back])], lengths[back]

    def _remember(self, parts: list[bytes], ids: np.ndarray, lengths: np.ndarray, often: np.ndarray) -> None:
        chosen = np.flatnonzero(often)
        cost = sum(len(parts[i]) for i in chosen.tolist()) + 4 * int(lengths[chosen].sum()) + PART_BYTES * len(chosen)
        if cost > self.memory:
            return
        if self.used + cost > self.memory:
            self._forget()
        self.used += cost
        first = len(self.lengths)
        self.known.update((parts[i], first + k) for k, i in enumerate(chosen.tolist()))
        starts = np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids[ragged(starts[chosen], lengths[chosen])]])
        self.lengths = np.concatenate([self.lengths, lengths[chosen]])

    def parts_of(
        self, parts: list[bytes], counts: np.ndarray, inner: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids at hand, and where those of each part begin in them and how many they are."""
        row = np.array([self.known.get(p, -1) for p in parts], np.int64)
        fresh = np.flatnonzero(row < 0)
        new = [parts[i] for i in fresh.tolist()]
        new_ids, new_lengths = self._encode_new(new, inner[fresh])
        row[fresh] = len(self.lengths) + np.arange(len(fresh))
        ids, lengths = np.concatenate([self.ids, new_ids]), np.concatenate([self.lengths, new_lengths])
        starts = np.cumsum(lengths) - lengths
        self._remember(new, new_ids, new_lengths, counts[fresh] > 1)
        return ids, starts[row], lengths[row]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column without nulls, joined, and how many each text has."""
        data, offsets = buffers(column)
        at = cut_parts(data, offsets, finer=True)
        parts, which = distinct_parts(data, at)
        inner = inner_parts(data, at, offsets, which, len(parts))
        ids, starts, lengths = self.parts_of(parts, np.bincount(which, minlength=len(parts)), inner)
        del parts, inner
        lengths = lengths[which]
        ids = ids[ragged(starts[which], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(ends[np.searchsorted(at, offsets)])


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, memory: int = MEMORY_BYTES, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once; ``memory`` trades remembered bytes for time."""
    key = (path, memory, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
