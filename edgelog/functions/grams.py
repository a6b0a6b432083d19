"""Grams of texts, cut by numpy in Arrow batches: runs of up to three characters, and blocks of eight.

A gram is a 64-bit number: one of its own for each run of up to three characters (and the empty one), a hash for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN, BLOCK = 3, 8
#: Bytes of text that are cut at once; the arrays made of them take about 60 times as much.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts (from 1), and how many each text has."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    return points, np.fromiter(map(len, strings), np.int64, len(strings))


def runs(points: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The numbers of the runs of up to three characters that begin at some places."""
    raw = np.zeros(len(at), np.uint64)
    for k in range(size):
        raw |= points[at + k] << np.uint64(21 * k)
    return _mix(raw)


def blocks(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of the blocks that begin at some places."""
    raw = np.zeros(len(at), np.uint64)
    for k in range(BLOCK):
        raw = raw * _BASE + points[at + k]
    return _mix(~raw)


def block_places(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of texts begin, one after the other, and which text's they are."""
    n = lengths // BLOCK
    of = np.repeat(np.arange(len(n)), n)
    return starts[of] + BLOCK * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)), of


def query_grams(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The turns of a query (see ``operators.triples.wanted_grams``) and the grams of each."""
    points, (length,) = characters([text])
    if length >= 2 * BLOCK - 1:
        for turn in range(BLOCK):
            yield turn, blocks(points, np.arange(turn, length - BLOCK + 1, BLOCK))
    else:
        size = min(int(length), RUN)
        yield 0, _once(runs(points, np.arange(length - size + 1), size))


def _once(values: np.ndarray) -> np.ndarray:
    """The different values, in order."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _distinct(codes: np.ndarray, bound: int, of: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a code (less than ``bound``) and a subject, in order."""
    names = None
    if bound * subjects >= 1 << 63:
        names, codes = np.unique(codes, return_inverse=True)
    pairs = _once(codes.astype(np.int64) * subjects + of)
    codes = pairs // subjects
    return (codes if names is None else names[codes]), pairs % subjects


def _found(points: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sizes, grams and subjects of texts, each pair once, a gram's subjects in order; ``of`` is each text's subject, from 0."""
    subjects = int(of[-1]) + 1
    yield 0, runs(points, np.zeros(subjects, np.int64), 0), np.arange(subjects)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    letters, rank = np.flatnonzero(seen).astype(np.uint64), (np.cumsum(seen) - 1)[points]
    text, many = np.repeat(np.arange(len(of)), lengths), len(letters)
    codes = np.zeros(len(points), np.int64)  # three of a million letters are less than 2 ** 62
    for size in range(1, RUN + 1):
        whole = len(points) - size + 1
        if whole <= 0:
            break
        codes = codes[:whole] * many + rank[size - 1 :]
        inside = text[:whole] == text[size - 1 :]
        code, subject = _distinct(codes[inside], many**size, of[text[:whole][inside]], subjects)
        own = np.empty((len(code), size), np.uint64)
        for k in range(size - 1, -1, -1):
            own[:, k], code = letters[(code % many).astype(np.int64)], code // many
        yield size, runs(own.ravel(), np.arange(len(own)) * size, size), subject
    at, which = block_places(lengths, np.cumsum(lengths) - lengths)
    hashes, code = np.unique(blocks(points, at), return_inverse=True)
    code, subject = _distinct(code, len(hashes), of[which], subjects)
    yield BLOCK, hashes[code], subject


class GramLists:
    """Lists of the subjects that have a gram, from texts of a language and in order of their subjects.

    Of grams shorter than ``RUN`` the first ``most`` subjects are listed, over all slices.
    """

    def __init__(self, most: int, parts: int):
        self.most, self.parts = most, parts
        self.listed: dict[int, int] = {}
        self.last: int | None = None

    def add(self, keys: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        """A row for each part (a gram modulo ``parts``): part, lists (gram, n, start from 1), subjects."""
        new = np.append(False, keys[1:] != keys[:-1])
        of = np.cumsum(new)
        names = keys[np.append(True, new[1:])]
        again = self.last == int(names[0])  # the subject has more labels than the last slice held
        self.last = int(names[-1])
        grams, sizes, subjects = [], [], []
        for size, gram, subject in _found(*characters(texts), of):
            first = np.flatnonzero(np.append(len(gram) > 0, gram[1:] != gram[:-1]))
            n = np.diff(np.append(first, len(gram)))
            gram = gram[first]
            if size < RUN:
                own = gram.tolist()
                more = again & (subject[first] == 0)
                take = np.minimum(n, self.most - np.array([self.listed.get(g, 0) for g in own], np.int64) + more)
                self.listed.update((g, self.listed.get(g, 0) + t) for g, t in zip(own, (take - more).tolist()))
                subject = subject[_ragged(first, take)]
                gram, n = gram[take > 0], take[take > 0]
            grams.append(gram)
            sizes.append(n)
            subjects.append(names[subject])
        gram, n, subject = np.concatenate(grams), np.concatenate(sizes), np.concatenate(subjects)
        part = (gram % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        subject = subject[_ragged((np.cumsum(n) - n)[order], n[order])]
        gram, n, part = gram[order], n[order], part[order]
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        bounds, ends = np.append(heads, len(part)), np.append(0, np.cumsum(n))
        start = ends[:-1] - np.repeat(ends[heads], np.diff(bounds)) + 1
        fields = [pa.array(gram.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(start.astype(np.int32))]
        lists = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(fields, ["gram", "n", "start"])
        )
        subjects = pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(subject.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), lists, subjects], ["part", "lists", "subjects"])


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all members of runs that begin at ``starts``."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def cut_labels(batches: Iterator[pa.RecordBatch], most: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``GramLists`` with their language, of rows (lang, key, haystack) in order of language and subject."""
    lang, lists = None, GramLists(most, parts)
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        keys = batch.column("key").to_numpy()
        texts = batch.column("haystack").cast(pa.large_binary()).to_pylist()
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and langs[last] == langs[first] and size + len(texts[last]) <= SLICE_BYTES:
                size += len(texts[last])
                last += 1
            if langs[first] != lang:
                lang, lists = langs[first], GramLists(most, parts)
            rows = lists.add(keys[first:last], texts[first:last])
            named = pa.array([lang] * rows.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([named, *rows.columns], ["lang", *rows.schema.names])
            first = last
