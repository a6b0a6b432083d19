"""What several of these operators need: columns, word splitting, vectorised hashing of words."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.session import new_shared_path

#: Bytes of text that are hashed at once; the arrays made of them take about 30 times as much.
SLICE_BYTES = 2 << 20

#: Stands for a missing document id, larger than all others.
NO_ID = np.iinfo(np.int64).max

_RANDOM = np.random.default_rng(20240607)
_BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _BASE2 = (int(x) | 1 for x in _RANDOM.integers(1 << 40, 1 << 62, 2))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII letters to lower case, everything else that is neither letter, digit nor beyond ASCII to a blank.
_ALNUM = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


#: Environment of Python workers: memory that a batch has used goes back to the system, not to a cache of its own.
_WORKERS = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_TRIM_THRESHOLD_": "67108864",
    "MALLOC_MMAP_THRESHOLD_": "33554432",
    "TOKENIZERS_PARALLELISM": "false",
}


def prepare_workers(spark: SparkSession) -> None:
    """Sets the environment of Python workers, and lets those of a local session import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    env.update(_WORKERS)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def give_back() -> None:
    """Returns memory that this worker has freed to the system.

    glibc keeps what lies scattered between things still in use, also after the stage that used it; elsewhere nothing is done.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, a function for ``mapInArrow``, before and after which the worker gives back what earlier work has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)
        give_back()

    return run


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text becomes empty."""
    prepare_workers(docs.sparkSession)
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def kept(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read back from there, so that its lineage is cut."""
    path = new_shared_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of everything beyond ASCII, ASCII letters in lower case."""
    return text.translate(_ALNUM).split()


def byte_texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` neighbouring words (``alnum_words``) of each text, and how many each text has.

    A text of fewer words, but not none, has one shingle: all its words. Hashes ascend within a text.
    """
    data, offsets = buffers(column)
    words, first = hash_words(np.frombuffer(_ALNUM, np.uint8)[data], offsets)
    n = np.diff(first)
    doc, place = np.repeat(np.arange(len(n)), n), np.arange(len(words)) - np.repeat(first[:-1], n)
    found, owner = [], []
    for k in range(1, size + 1):
        windows = hash_windows(words, k)
        of, at = doc[: len(windows)], place[: len(windows)]
        own = (at + k <= n[of]) if k == size else (n[of] == k) & (at == 0)
        found.append(mix(windows[own] + np.uint64(k)))
        owner.append(of[own])
    hashes, owners = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (np.diff(hashes) != 0) | (np.diff(owners) != 0)
    return hashes[new], np.bincount(owners[new], minlength=len(n))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)), dtype=np.uint64)
                for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_BASE2)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of the texts ``data[offsets[i]:offsets[i + 1]]``.

    Returns the hashes and, for every text, the number of words before it (one entry more than texts).
    """
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1] if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:] if len(data) else solid
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = _BYTES.to(len(data) + 1)
    total = _sums(_BYTE_CODE[data] * up[: len(data)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every ``size`` neighbouring word hashes."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.to(len(words) + 1)
    total = _sums(words * up[: len(words)])
    n = len(words) - size + 1
    return mix((total[size:] - total[:n]) * down[:n])


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that their column ``text`` has about ``limit`` bytes; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column("text"))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins (one entry more)."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
