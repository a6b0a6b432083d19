"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes of a text, and how usual each such link is.

1. Texts are cut at single blanks, where tokens of both vocabularies begin, and each distinct part of a slice of texts is
   encoded and aligned once. Two lists of byte offsets, at which the tokens of A and of B end, are intersected by
   galloping: the shorter list of a part drives, and for all its offsets at once an exponential and then a binary search
   finds their rank in the longer one. Equal offsets slice the tokens into groups; rank differences give the
   range of tokens that a token overlaps.
2. A slice becomes one row: its documents as numbers of parts, its parts as numbers of id pairs, and how often each id pair
   is linked in it. The counts are summed over all slices in Spark.
3. The sums go back to the slices that have the pair, which add them up for their documents. Neither
   texts nor links are encoded or shuffled again, and no task holds more than a slice.

Texts of the contract: a blank and the text; B adds the blank itself. A text whose tokens of A or B do not give
back exactly these bytes (a null or empty one, too) has no tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.shared import buffers, freeing, give_back, kept, slices, texts_of
from edgelog.llm.token_counts import byte_of_letter
from edgelog.llm.tokens import Encoder, cut_parts, distinct_parts, inner_parts, ragged

#: Bytes of text in a slice, and parts that are given to B's library at once.
SLICE_BYTES, CALL_PARTS = 2 << 20, 20_000
#: Parts whose groups become text at once: a group's ids are Python objects meanwhile.
TEXT_PARTS = 4096
#: Bytes of remembered parts in a worker; with half as many, encoding for A took over a third longer.
MEMORY_BYTES = 32 << 20
#: Parts whose groups become text at once: a group's ids are Python objects meanwhile.
TEXT_PARTS = 4096
#: Bytes of remembered parts: few parts of a slice are new to the library's own cache, so more would save next to no time.
MEMORY_BYTES = 16 << 20


def gallop(short: np.ndarray, long: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the number of members of ``long[low:high]`` (ascending) that are less, and whether one is equal."""
    step, left, right = np.ones(len(short), np.int64), low.astype(np.int64), high.astype(np.int64)
    open_ = np.arange(len(short))
    while len(open_):  # twice as far each time, until a member is not less or the end is reached
        probe = left[open_] + step[open_] - 1
        inside = probe < right[open_]
        less = np.zeros(len(open_), bool)
        less[inside] = long[probe[inside]] < short[open_[inside]]
        stop = open_[inside & ~less]
        right[stop] = np.minimum(right[stop], left[stop] + step[stop] - 1)
        open_ = open_[less]
        left[open_] += step[open_]
        step[open_] *= 2
    open_ = np.flatnonzero(left < right)
    while len(open_):
        middle = (left[open_] + right[open_]) // 2
        less = long[middle] < short[open_]
        left[open_] = np.where(less, middle + 1, left[open_])
        right[open_] = np.where(less, right[open_], middle)
        open_ = open_[left[open_] < right[open_]]
    equal = left < high
    equal[equal] = long[left[equal]] == short[equal]
    return left - low, equal


class Aligned:
    """Tokens of A and B that lie on the same bytes. ``n_a`` and ``n_b`` are the numbers of tokens of each sequence, and
    ``ends_a`` and ``ends_b`` where they end, ascending over all sequences; a sequence ends at the same place in both."""

    def __init__(self, n_a: np.ndarray, ends_a: np.ndarray, n_b: np.ndarray, ends_b: np.ndarray):
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        drives = n_a <= n_b
        sides = []
        for own, n, first, ends, m, far, others in (
            (np.flatnonzero(drives), n_a, first_a, ends_a, n_b, first_b, ends_b),
            (np.flatnonzero(~drives), n_b, first_b, ends_b, n_a, first_a, ends_a),
        ):
            token = ragged(first[own], n[own])
            low = np.repeat(far[own], n[own])
            less, equal = gallop(ends[token], others, low, low + np.repeat(m[own], n[own]))
            rank = low + less
            # a token overlaps from the one behind the last end before its own start to the one that reaches its end
            opens = np.empty(len(token), np.int64)
            opens[1:] = (rank + equal)[:-1]
            heads = np.cumsum(n[own]) - n[own]
            opens[heads[n[own] > 0]] = far[own][n[own] > 0]
            count = rank - opens + 1
            sides.append((token, rank, equal, np.repeat(token, count), ragged(opens, count)))
        (a, rank_b, equal_a, link_a, link_b), (b, rank_a, equal_b, link_b2, link_a2) = sides
        self.common_a = np.sort(np.concatenate([a[equal_a], rank_a[equal_b]]))
        self.common_b = np.sort(np.concatenate([rank_b[equal_a], b[equal_b]]))
        link_a, link_b = np.concatenate([link_a, link_a2]), np.concatenate([link_b, link_b2])
        order = np.lexsort((link_b, link_a))
        self.link_a, self.link_b = link_a[order], link_b[order]
        until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
        self.n_links = np.diff(np.searchsorted(self.link_a, until_a), prepend=0)
        self.n_groups = np.diff(np.searchsorted(self.common_a, until_a), prepend=0)
        assert len(until_b) == len(until_a)


def _byte_tables(path_a: str, path_b: str):
    """The bytes of each id of A (byte-level vocabulary) and B (sentencepiece model)."""
    from sentencepiece import SentencePieceProcessor

    with open(path_a, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_of_letter()
    of_a = {i: bytes(map(letters.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
    model = SentencePieceProcessor(model_file=path_b)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError(f"{path_b} has pieces that go on behind a blank")
    of_b = {
        i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(pieces)
        if not (model.is_control(i) or model.is_unknown(i))
    }
    return model, *(_table(t) for t in (of_a, of_b))


def _table(of: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.zeros(max(of) + 1, np.int64)
    for i, b in of.items():
        sizes[i] = len(b)
    data = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)
    return data, np.cumsum(sizes) - sizes, sizes


class _Pair:
    """Both vocabularies, loaded once in a worker, which drops them with the first slices that are aligned already."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Encoder(path_a, MEMORY_BYTES, plain=True)
        self.model_b, self.bytes_a, self.bytes_b = _byte_tables(path_a, path_b)
        self.names = list(map(str, range(max(len(self.bytes_a[2]), len(self.bytes_b[2])))))

    def _ids_b(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), CALL_PARTS):
            found = self.model_b.encode([p[1:].decode() for p in parts[at : at + CALL_PARTS]], num_threads=1)
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for own in found for i in own), np.int64, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def tokens(self, parts: list[bytes], counts: np.ndarray, inner: np.ndarray):
        """Ids and numbers of ids of A and B of every part, and which parts both give back (others have none)."""
        pool, starts, n_a = self.a.parts_of(parts, counts, inner)
        a = pool[ragged(starts, n_a)].astype(np.int64)
        b, n_b = self._ids_b(parts)
        expected = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        good = np.ones(len(parts), bool)
        for ids, n, (data, first, width) in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            own = np.repeat(np.arange(len(parts)), n)
            known = ids < len(width)
            ids = np.where(known, ids, 0)
            total = np.bincount(own, width[ids] * known, len(parts)).astype(np.int64)
            good &= total == sizes
            keep = good[own] & known
            got = data[ragged(first[ids[keep]], width[ids[keep]])]
            at = np.repeat(np.arange(len(parts))[good], sizes[good])
            wanted = expected[ragged((np.cumsum(sizes) - sizes)[good], sizes[good])]
            good[at[got != wanted]] = False
        out = []
        for ids, n, (_, _, width) in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            n_good = np.where(good, n, 0)
            ids = ids[ragged(np.cumsum(n) - n, n_good)]
            out += [ids, n_good, np.cumsum(width[ids])]
        return good, *out


_PAIRS: dict[tuple[str, str], _Pair] = {}


def _drop_vocabularies() -> None:
    """The steps behind the encoding run in its workers, and need the memory for other things."""
    _PAIRS.clear()
    give_back()


def _group_texts(a: np.ndarray, b: np.ndarray, found: Aligned, names: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every sequence; ``names`` has the text of every id."""
    out, i, j, at = [], 0, 0, 0
    for first in range(0, len(found.n_groups), TEXT_PARTS):
        sizes = found.n_groups[first : first + TEXT_PARTS].tolist()
        until = at + sum(sizes)
        ends_a, ends_b = found.common_a[at:until] + 1, found.common_b[at:until] + 1
        names_a, names_b = ([names[k] for k in ids.tolist()] for ids in (a[i : ends_a.max(initial=i)], b[j : ends_b.max(initial=j)]))
        groups, x, y = [], 0, 0
        for x_end, y_end in zip((ends_a - i).tolist(), (ends_b - j).tolist()):
            groups.append(f"{','.join(names_a[x:x_end])}|{','.join(names_b[y:y_end])}")
            x, y = x_end, y_end
        i, j, at, k = i + x, j + y, until, 0
        for n in sizes:
            out.append(";".join(groups[k : k + n]))
            k += n
    return out


def _packed(values: np.ndarray) -> bytes:
    """The size in bytes, and the compressed bytes: what Spark holds, sorts and sends of a slice is less than half as large."""
    data = values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), kind)


SLICED = (
    "slice bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "n_links array<bigint>, groups array<string>, parts binary, n_parts binary, links binary, part_links binary, "
    "pairs binary, pair_counts binary"
)


def _slice_rows(docs: DataFrame, path_a: str, path_b: str, digest: bool, limit: int) -> DataFrame:
    def aligned(both: _Pair, number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch.column("text"))
        some = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][some], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        at = cut_parts(data, offsets)
        parts, which = distinct_parts(data, at)
        counts = np.bincount(which, minlength=len(parts))
        inner = inner_parts(data, at, offsets, which, len(parts))
        good, a, n_a, ends_a, b, n_b, ends_b = both.tokens(parts, counts, inner)
        found = Aligned(n_a, ends_a, n_b, ends_b)
        del data, inner, counts, parts, ends_a, ends_b
        first = np.searchsorted(at, offsets)  # of each text's parts
        bad = np.concatenate([[0], np.cumsum(~good[which])])
        clean = bad[first[1:]] == bad[first[:-1]]
        n_parts = np.where(clean, np.diff(first), 0)
        which = which[ragged(first[:-1], n_parts)]
        ends = np.concatenate([[0], np.cumsum(n_parts)])
        sums = []
        for n in (n_a, n_b, found.n_groups, found.n_links):
            total = np.concatenate([[0], np.cumsum(n[which])])
            sums.append(np.diff(total[ends]))
        texts = _group_texts(a, b, found, both.names)
        groups = []
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = ";".join([texts[k] for k in which[x:y].tolist()])
            groups.append(hashlib.sha256(own.encode()).hexdigest() if digest and own else own)
        del texts
        used = np.bincount(which, minlength=len(good))
        links = (a[found.link_a] << 32) | b[found.link_b]
        pairs, links = np.unique(links, return_inverse=True)
        weight = np.repeat(used, found.n_links)
        pair_counts = np.zeros(len(pairs), np.int64)
        np.add.at(pair_counts, links, weight)
        values = [number, batch.column("doc_id").to_pylist(), *(s.tolist() for s in sums), groups]
        values += [
            _packed(which.astype("<i4")), _packed(n_parts.astype("<i8")), _packed(links.astype("<i4")),
            _packed(found.n_links.astype("<i4")), _packed(pairs.astype("<i8")), _packed(pair_counts.astype("<i8")),
        ]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), *[longs] * 5, pa.list_(pa.string()), *[pa.binary()] * 6]
        names = [c.split()[0] for c in SLICED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _PAIRS.get((path_a, path_b)) or _PAIRS.setdefault((path_a, path_b), _Pair(path_a, path_b))
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit):
            row = aligned(both, number, batch)
            give_back()  # a slice leaves more than a hundred megabytes behind
            yield row
            number += 1

    return docs.mapInArrow(freeing(align), SLICED)


def _slice_pairs(rows: DataFrame) -> DataFrame:
    """slice, a, b, n: how often a pair of ids is linked in a slice."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_vocabularies()
        for batch in batches:
            for number, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, counts = _unpacked(pairs, "<i8"), _unpacked(counts, "<i8")
                some = counts > 0
                pairs, counts = pairs[some], counts[some]
                columns = [np.full(len(pairs), number), (pairs >> 32).astype(np.int32), pairs.astype(np.int32), counts]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["slice", "a", "b", "n"])

    return rows.select("slice", "pairs", "pair_counts").mapInArrow(freeing(unpack), "slice bigint, a int, b int, n bigint")


def _pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """a, b, count: how many links of all texts hold the pair of ids linked."""
    return _pair_counts(_slice_pairs(_slice_rows(texts_of(docs), path_a, path_b, True, slice_bytes)))


ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups string"
)


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """A row for every row of ``docs``: doc_id, tokens of A and B, groups, links, links whose count is the highest of
    their id of B (``n_best``), sum of the links' counts, and the groups as text (``digest``: their SHA-256).

    ``path_a`` is a byte-level BPE file, ``path_b`` a sentencepiece model. Null and empty texts and those that an encoding
    does not give back have zeros and an empty text. Repeated rows and rows without an id count as they are; other columns
    are not looked at; an empty table gives no rows.
    """
    rows = kept(_slice_rows(texts_of(docs), path_a, path_b, digest, slice_bytes))
    pairs = _slice_pairs(rows)
    counts = kept(_pair_counts(pairs))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # one row for each id of B at most
    counts = counts.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    needed = pairs.drop("n").join(counts, ["a", "b"])

    def finish(own: pa.Table, sums: pa.Table) -> pa.Table:
        _drop_vocabularies()
        out = []
        for row in own.to_pylist():
            pairs = _unpacked(row["pairs"], "<i8")
            key = (sums.column("a").to_numpy().astype(np.int64) << 32) | sums.column("b").to_numpy()
            at = np.searchsorted(pairs, key)
            count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            count[at] = sums.column("count").to_numpy()
            best[at] = sums.column("best").to_numpy(zero_copy_only=False)
            which, n_parts = _unpacked(row["parts"], "<i4"), _unpacked(row["n_parts"], "<i8")
            links, n_links = _unpacked(row["links"], "<i4"), _unpacked(row["part_links"], "<i4")
            link_ends = np.concatenate([[0], np.cumsum(n_links, dtype=np.int64)])
            ends = np.concatenate([[0], np.cumsum(n_parts)])
            sums_of = []
            for of_pair in (best, count):
                of_link = np.concatenate([[0], np.cumsum(of_pair[links])])
                of_part = np.diff(of_link[link_ends])
                sums_of.append(np.diff(np.concatenate([[0], np.cumsum(of_part[which])])[ends]))
            columns = [row[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + sums_of
            columns = [pa.array(c, pa.int64()) for c in columns] + [pa.array(row["groups"], pa.string())]
            out.append(pa.table(columns, [c.split()[0] for c in ALIGNED.split(", ")]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 7 + [pa.array([], pa.string())], [c.split()[0] for c in ALIGNED.split(", ")])

    return rows.groupBy("slice").cogroup(needed.groupBy("slice")).applyInArrow(finish, ALIGNED)
