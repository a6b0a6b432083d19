"""Best-fit packing of token sequences with a fixed number of open bins.

Documents are cut only where they are longer than a sequence. Pieces go to packing tasks at random, where a
bitset keyed by free space finds the open bin that a piece fills best. With too many open bins the fullest
one closes first. A task packs about ``PIECES_PER_TASK`` pieces, so about one unfilled bin in a thousand comes
from dividing the work; a task reads its pieces as a stream and keeps ``open_bins`` numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.shared import give_back, slices, texts_of
from edgelog.llm.tokens import MEMORY_BYTES, TEXT_BYTES, encoder

CAPACITY = 4096
OPEN_BINS = 8192
PIECES_PER_TASK = 20_000


class OpenBins:
    """Online best fit over at most ``limit`` open bins."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.count, self.made = capacity, limit, 0, 0
        self.free = 0  # bit f: some open bin has f places free
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << free)
        self.count -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece; a length over the capacity is an error."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit into {self.capacity}")
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.count == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            self.by_free.setdefault(left, []).append(chosen)
            self.free |= 1 << left
            self.count += 1
        return chosen, self.capacity - free


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def tokenize_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    memory: int = MEMORY_BYTES,
) -> DataFrame:
    """A row for every piece: doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit, or null)."""

    def pieces_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        end, width, rows = int(end_id).to_bytes(4, "little"), 4 * capacity, []
        ids, counts = encoder(tokenizer, memory).encode(batch.column("text"))
        data, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(counts).tolist()
        del ids
        for doc_id, last, n in zip(batch.column("doc_id").to_pylist(), ends, counts.tolist()):
            own_ids = bytes(data[4 * (last - n) : 4 * last]) + end
            for piece, at in enumerate(range(0, len(own_ids), width)):
                own = own_ids[at : at + width]
                rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages of this worker have left
        for batch in slices(batches, TEXT_BYTES):
            yield pieces_of(batch)
            give_back()

    return texts_of(docs).mapInArrow(cut, PIECES)


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int = 1
) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` must be from 1 to ``capacity``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            columns = [*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    order = [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "start", "length"]
    return pieces.repartition(tasks).sortWithinPartitions(*order).mapInArrow(pack, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    keep_ids: bool = True,
    memory: int = MEMORY_BYTES,
) -> DataFrame:
    """All documents (null text: empty; repeated rows and null ids as they are) in sequences of ``capacity``."""
    tasks = 1 + docs.count() // PIECES_PER_TASK
    pieces = tokenize_pieces(docs, tokenizer, end_id, capacity, keep_ids, memory)
    return pack_pieces(pieces if keep_ids else pieces.drop("ids"), capacity, open_bins, tasks)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and ids (joined in order of offset) of packed pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.col("parts.doc_id").alias("doc_ids"),
        F.aggregate("parts", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])).alias("ids"),
    )
