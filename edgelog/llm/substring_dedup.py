"""Substring dedup with prefix-partitioned suffix trees over words.

A document is a string of words; the suffix at a word is what follows from there on. Two suffixes that share
``size`` words hang below the same node at depth ``size``, so the suffix tree, cut off at that depth, tells
every repeated passage. It is built in parts:

1. Suffixes are ordered by a code of 16 hashed bits for each of their first four words. Counting how many
   suffixes have each prefix, and lengthening the prefix of those that are too many, word by word, gives
   prefixes of variable length, put together to groups that fit into memory (``Cut``). What shares four words
   and is still too much is divided by the hash of the whole window.
2. Each task dedups the windows of a slice of documents on its own (a passage that a third of all documents
   share leaves one entry per slice) and sends the suffixes to their groups, packed in arrays.
3. In its group a subtree is built by sorting: the suffixes below one deep node become neighbours. Suffixes that
   are not from the node's smallest document are repeats; overlapping ones make up the maximal repeats.
4. Repeats go back to buckets of documents, where they meet the texts (packed as well).

Windows are told apart by 56 hashed bits within a group, that is by about 56 + log2(groups) bits.
Texts are never cut: a window lies within one document whatever its length. Documents without an id count as
larger than all others. Rows with the same id and text get the same result; a document is no repeat of one
with its own id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.shared import NO_ID, buffers, byte_texts, hash_windows, hash_words, slices, texts_of

SIZE = 13
GROUP_SUFFIXES = 2_000_000
MAX_GROUPS = 1_000_000
BUCKET_BYTES = 24 << 20

RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
_U64 = np.uint64


class Slice:
    """The suffixes of some documents: their codes and window hashes, in order of document and place."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        data, offsets = buffers(batch.column("text"))
        words, first = hash_words(data, offsets)
        self.ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.checks = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:])], np.uint32)
        windows = hash_windows(words, size)
        n = len(windows)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(first))[:n]
        inside = np.arange(n) + size <= first[1:][doc] if n else np.zeros(0, bool)
        top = words >> _U64(48)
        code = np.zeros(n, _U64)
        for k in range(4):
            code |= top[k : k + n] << _U64(48 - 16 * k)
        at = np.flatnonzero(inside)
        self.doc, self.place = doc[at], at - first[:-1][doc[at]]
        self.code, self.window = code[at], windows[at]

    def split_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of suffixes from the smallest document of their window, and of the others (sure repeats)."""
        order = np.lexsort((self.ids[self.doc], self.window))
        new = np.concatenate([[True], np.diff(self.window[order]) != 0]) if len(order) else np.zeros(0, bool)
        least = self.ids[self.doc[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        repeat = self.ids[self.doc[order]] > least
        return np.sort(order[~repeat]), np.sort(order[repeat])


class Cut:
    """Which group a suffix belongs to: ranges of codes, some of them divided by window hash."""

    def __init__(self, bounds: np.ndarray, first_group: np.ndarray, parts: np.ndarray):
        self.bounds, self.first_group, self.parts = bounds, first_group, parts

    def groups(self, code: np.ndarray, window: np.ndarray) -> np.ndarray:
        leaf = np.searchsorted(self.bounds, code, side="right") - 1
        return self.first_group[leaf] + ((window >> _U64(40)) % self.parts[leaf].astype(_U64)).astype(np.int64)


def _prefix_counts(docs: DataFrame, size: int, words: int, under: np.ndarray) -> list[tuple[int, int]]:
    """How many suffixes have each prefix of ``words`` words that lengthens one of ``under``.

    At most 65,536 numbers for each of ``under``; equal windows within a slice count once.
    """
    shift, known = _U64(64 - 16 * words), np.sort(under)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = Slice(batch, size)
            code = part.code[np.unique(part.window, return_index=True)[1]] >> shift
            if words > 1:
                above = code >> _U64(16)
                code = code[known[np.minimum(np.searchsorted(known, above), len(known) - 1)] == above]
            prefix, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix.view(np.int64)), pa.array(n.astype(np.int64))], ["prefix", "n"]
            )

    counts = docs.mapInArrow(count, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    return [(r["prefix"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in counts.toLocalIterator()]


def cut_prefixes(docs: DataFrame, size: int = SIZE, group_suffixes: int = GROUP_SUFFIXES) -> tuple[Cut, int]:
    """The cut, and how many groups it has (at most about ``MAX_GROUPS`` and a few per long prefix)."""
    limit, leaves, under, words = group_suffixes, [], np.zeros(1, _U64), 1
    while True:
        counts = _prefix_counts(docs, size, words, under)
        if words == 1:
            limit = max(limit, sum(n for _, n in counts) // MAX_GROUPS)
        heavy = [p for p, n in counts if n > limit] if words < 4 else []
        again = set(heavy)
        leaves += [(p << (64 - 16 * words), n) for p, n in counts if p not in again]
        if not heavy:
            break
        under, words = np.array(heavy, _U64), words + 1
    leaves.sort()
    bounds, first_group, parts, group, filled = [0], [0], [1], 0, 0
    for bound, n in leaves:
        if n > limit:
            pieces = -(-n // limit)
            bounds.append(bound), first_group.append(group + 1), parts.append(pieces)
            group, filled = group + pieces, limit
        elif filled + n > limit:
            group, filled = group + 1, n
            bounds.append(bound), first_group.append(group), parts.append(1)
        else:
            if parts[-1] > 1:
                group, filled = group + 1, 0
                bounds.append(bound), first_group.append(group), parts.append(1)
            filled += n
    return Cut(np.array(bounds, _U64), np.array(first_group), np.array(parts)), group + 1


def _packed(ids, checks, counts, places, hashes) -> list[bytes]:
    """Documents of a pack, how many entries each has, places, and 7 bytes of each window hash, by planes."""
    planes = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :7]) if len(hashes) else hashes
    step = np.ascontiguousarray(places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T) if len(places) else places
    near = np.diff(ids, prepend=0)
    return [
        np.ascontiguousarray(near.view(np.uint8).reshape(-1, 8).T).tobytes(),
        checks.astype(np.uint32).tobytes(),
        np.ascontiguousarray(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(),
        step.tobytes(),
        planes.tobytes(),
    ]


def _planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


PACK = "target int, known boolean, ids binary, checks binary, counts binary, places binary, hashes binary"
_NAMES = ["target", "known", "ids", "checks", "counts", "places", "hashes"]
_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]


def _pack(target, known, ids, checks, doc, place, hashes) -> list:
    """One pack of entries; ``doc`` ascends and points into ``ids`` and ``checks``."""
    used, start, counts = np.unique(doc, return_index=True, return_counts=True)
    step = np.diff(place, prepend=0)
    step[start] = place[start]
    return [target, known, *_packed(ids[used], checks[used], counts, step, hashes)]


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, checks, doc, place and hash of a pack's entries."""
    ids = np.cumsum(_planes(row["ids"], np.int64))
    counts = _planes(row["counts"], np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), counts)
    run = np.cumsum(_planes(row["places"], np.uint32).astype(np.int64))
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, run[first - 1], 0)
    hashes = np.zeros((len(doc) if row["hashes"] else 0, 8), np.uint8)
    hashes[:, :7] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, 7)
    return ids, np.frombuffer(row["checks"], np.uint32), doc, run - before[doc], hashes.view(_U64).ravel()


def _batch(rows: list[list], names=_NAMES, types=_TYPES) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _send(docs: DataFrame, size: int, cut: Cut) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = Slice(batch, size)
            open_, sure = part.split_repeats()
            for known, chosen in ((False, open_), (True, sure)):
                target = cut.groups(part.code[chosen], part.window[chosen])
                order = np.argsort(target, kind="stable")
                ends = np.flatnonzero(np.diff(target[order], append=-1)) + 1
                for a, b in zip(np.concatenate([[0], ends]), ends):
                    at = chosen[order[a:b]]
                    hashes = np.zeros(0, _U64) if known else part.window[at]
                    where = int(target[order[a]])
                    yield _batch([_pack(where, known, part.ids, part.checks, part.doc[at], part.place[at], hashes)])

    return docs.mapInArrow(send, PACK)


def _bucket(ids: np.ndarray, checks: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids.astype(_U64) * _U64(0x9E3779B97F4A7C15) >> _U64(20)) ^ checks.astype(_U64)) % _U64(buckets)


def _find_repeats(packs: DataFrame, buckets: int) -> DataFrame:
    def subtree(table: pa.Table) -> pa.Table:
        parts, base = [], 0
        for batch in table.to_batches():
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in _NAMES}
                ids, checks, doc, place, window = _unpack(row)
                known = np.full(len(doc), row["known"])
                parts.append((ids, checks, (doc + base).astype(np.int32), place.astype(np.int32), window, known))
                base += len(ids)
        ids, checks, doc, place, window, known = map(np.concatenate, zip(*parts))
        del parts
        open_ = np.flatnonzero(~known)
        order = np.argsort(window)
        node = np.flatnonzero(np.concatenate([[True], np.diff(window[order]) != 0])) if len(order) else order
        open_ = open_[order]  # in the order of the leaves
        owner = ids[doc[open_]]
        least = np.repeat(np.minimum.reduceat(owner, node), np.diff(node, append=len(owner))) if len(owner) else owner
        repeats = np.concatenate([open_[owner > least], np.flatnonzero(known)])
        del order, node, owner, least, open_, window
        repeats = repeats[np.lexsort((place[repeats], doc[repeats]))]
        bucket = _bucket(ids, checks, buckets)[doc[repeats]].astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[by], append=-1)) + 1
        out = []
        for a, b in zip(np.concatenate([[0], ends]), ends):
            at = repeats[by[a:b]]
            out.append(_pack(int(bucket[by[a]]), True, ids, checks, doc[at], place[at], np.zeros(0, _U64)))
        return pa.Table.from_batches([_batch(out)])

    return packs.groupBy("target").applyInArrow(subtree, PACK)


TEXTS = "target int, texts binary"


def _send_texts(docs: DataFrame, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = byte_texts(batch.column("text"))
            checks = np.array([zlib.crc32(t) for t in texts], np.uint32)
            bucket = _bucket(ids, checks, buckets).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[by], append=-1)) + 1
            for a, b in zip(np.concatenate([[0], ends]), ends):
                at = by[a:b]
                own = [texts[i] for i in at]
                lengths = np.array([len(t) for t in own], np.int64)
                head = np.array([len(at)], np.int64).tobytes()
                data = b"".join([head, ids[at].tobytes(), checks[at].tobytes(), lengths.tobytes(), *own])
                yield _batch([[int(bucket[by[a]]), squeeze.compress(data)]], ["target", "texts"], [pa.int32(), pa.binary()])

    return docs.mapInArrow(send, TEXTS)


def _unpack_texts(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids = np.frombuffer(data, np.int64, n, 8)
    checks = np.frombuffer(data, np.uint32, n, 8 + 8 * n)
    at = 8 + 12 * n
    lengths = np.frombuffer(data[at : at + 8 * n], np.int64)
    at += 8 * n
    for i, check, length in zip(ids.tolist(), checks.tolist(), lengths.tolist()):
        yield i, check, data[at : at + length]
        at += length


def _remove(texts: DataFrame, repeats: DataFrame, size: int, digest: bool) -> DataFrame:
    def remove(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        places: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in repeats.to_pylist():
            ids, checks, doc, place, _ = _unpack(row)
            ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
            for a, b in zip(np.concatenate([[0], ends]), ends):
                places.setdefault((int(ids[doc[a]]), int(checks[doc[a]])), []).append(place[a:b])
        rows = []
        for pack in texts.column("texts"):
            for i, check, text in _unpack_texts(pack.as_py()):
                words, n_removed = text.split(), 0
                n = len(words)
                if found := places.get((i, check)):
                    edges = np.zeros(n + 1, np.int64)
                    starts = np.unique(np.concatenate(found))
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + size, -1)
                    keep = np.cumsum(edges)[:n] == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                    n_removed = n - len(words)
                kept = b" ".join(words)
                kept = hashlib.sha256(kept).hexdigest() if digest else kept.decode()
                rows.append([None if i == NO_ID else i, n, n_removed, kept])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.Table.from_batches([_batch(rows, ["doc_id", "n_words", "n_removed", "kept"], types)])

    pairs = texts.groupBy("target").cogroup(repeats.groupBy("target"))
    return pairs.applyInArrow(remove, RESULT)


def remove_repeats(
    docs: DataFrame, size: int = SIZE, digest: bool = False, group_suffixes: int = GROUP_SUFFIXES
) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of each document without those that a document with a smaller
    id has in a passage of ``size`` words or more, joined by blanks (or, with ``digest``, the SHA-256 of that).

    Words are runs without ASCII white space, unchanged; a null text has none.
    """
    docs = texts_of(docs)
    cut, _ = cut_prefixes(docs, size, group_suffixes)
    size_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size_of // BUCKET_BYTES)
    repeats = _find_repeats(_send(docs, size, cut), buckets)
    return _remove(_send_texts(docs, buckets), repeats, size, digest)
