"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece wherever it is ``block - 1`` modulo the block size (3, 6, 12, ...). Each
piece gives one of 64 characters. The block size is the smallest with at most ``PIECES`` pieces, so nothing is cut off;
a second signature has the next larger one. The fingerprint is ``block:signature:second signature``.

Fingerprints are compared by the edit distance of signatures of the same block size, if they share one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.llm.shared import slices, texts_of

PIECES = 64
SMALLEST_BLOCK = 3
BUCKET_BYTES = 16 << 20

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODE = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_STEPS = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(7)]


def fingerprint(text: bytes) -> str:
    """The fingerprint of a text's bytes; that of an empty text is ``3::``."""
    if not text:
        return f"{SMALLEST_BLOCK}::"
    codes = _CODE[np.frombuffer(text, np.uint8)]
    rolling = codes.copy()
    for k in range(1, min(7, len(codes))):
        rolling[k:] += codes[:-k] * _STEPS[k]
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x2C1B3C6D)
    rolling ^= rolling >> np.uint32(13)
    at = np.flatnonzero(rolling % np.uint32(3) == 2)
    more = (rolling[at] // np.uint32(3) + np.uint32(1)).astype(np.int64)
    # h is block - 1 modulo block = 3 * 2**k if 2**k divides (h + 1) / 3
    level = np.log2((more & -more).astype(np.float64)).astype(np.int64)
    inner = at + 1 < len(text)
    at, level = at[inner] + 1, level[inner]
    counts = np.bincount(level, minlength=1)[::-1].cumsum()[::-1] + 1
    k = int(np.argmax(counts <= PIECES)) if (counts <= PIECES).any() else len(counts)

    def signature(k: int) -> str:
        ends = [*at[level >= k].tolist(), len(text)]
        return "".join(_ALPHABET[zlib.crc32(text[a:b]) & 63] for a, b in zip([0, *ends], ends))

    return f"{SMALLEST_BLOCK << k}:{signature(k)}:{signature(k + 1)}"


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal fingerprints, 0 if no block size is common; null if one is null."""

    def parts(c: Column) -> tuple[Column, Column, Column]:
        split = F.split(c, ":")
        return split[0].cast("bigint"), split[1], split[2]

    def same(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)

    (block_a, a1, a2), (block_b, b1, b2) = parts(a), parts(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(a == b, 1.0)
        .when(block_a == block_b, same(a1, b1))
        .when(block_a == 2 * block_b, same(a1, b2))
        .when(block_b == 2 * block_a, same(a2, b1))
        .otherwise(0.0)
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; a null text counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(hashed, "doc_id bigint, fp string").withColumnRenamed("fp", "fingerprint")


# --- documents against an edited form of themselves ---------------------------------------------

ROUTED = "bucket int, ahead boolean, doc_id bigint, text string, fingerprint string"
EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "next_fingerprint string"
)


def _bucket_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Buckets of descending ids; those without an id come last."""
    least = np.iinfo(np.int64).min
    found = len(cuts) - np.searchsorted(cuts, ids.fill_null(least).to_numpy(zero_copy_only=False), side="right")
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), found)


def _cuts(docs: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Ids that divide the documents into buckets of about ``BUCKET_BYTES``, and the largest id of each bucket."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, size // BUCKET_BYTES)
    if n == 1:
        return np.zeros(0, np.int64), {}
    shares = [k / n for k in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * n).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(found or [], np.int64))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("doc_id")
            bucket = _bucket_of(ids, cuts)
            values = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            for b in np.unique(bucket).tolist():
                best[b] = max(best.get(b, values.min()), values[bucket == b].max())
        columns = [pa.array(list(best), pa.int32()), pa.array([int(v) for v in best.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id"])

    heads = docs.select("doc_id").mapInArrow(largest, "bucket int, doc_id bigint")
    return cuts, {r["bucket"]: r["m"] for r in heads.groupBy("bucket").agg(F.max("doc_id").alias("m")).collect()}


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with the text that results when its last floor(n / 2) code points are replaced by the first as
    many (or all) of the next document in descending order of doc_id; after the last comes the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint. Rows of one id are
    ordered by text, rows without an id come last. A lone document is its own next one. Documents are
    divided by id and sorted; the first of each bucket is also sent to the bucket before it.
    """
    docs = texts_of(docs)
    cuts, heads = _cuts(docs)
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)} if len(order) > 1 else {}
    least = np.iinfo(np.int64).min

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            rows = []
            for b, i, text in zip(_bucket_of(ids, cuts).tolist(), ids.to_pylist(), texts):
                fp = fingerprint(text.encode())
                rows.append((b, False, i, text, fp))
                if b in before and (least if i is None else i) == heads[b]:
                    rows.append((before[b], True, i, text, fp))
            types = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
            names = ["bucket", "ahead", "doc_id", "text", "fingerprint"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 4]

        def edited(row, following):
            (_, _, doc_id, text, own), (_, _, _, other, next_own) = row, following
            half = len(text) // 2
            result = (text[: len(text) - half] + other[:half]).encode()
            return doc_id, len(text), hashlib.sha256(result).hexdigest(), own, fingerprint(result), next_own

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        first = last = None
        for batch in slices(batches):
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and not last[1]:
                    # without a copy of another bucket's first row, the next one is the bucket's own first
                    rows.append(edited(last, row if row[0] == last[0] else first))
                if last is None or row[0] != last[0]:
                    first = row
                last = row
            if rows:
                yield packed(rows)
        if last is not None and not last[1]:
            yield packed([edited(last, first)])

    routed = docs.mapInArrow(route, ROUTED).repartition(max(1, len(cuts) + 1), "bucket")
    routed = routed.sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")
    return routed.mapInArrow(edit, EDITED)


def report(edited: DataFrame) -> DataFrame:
    fp = F.col("fingerprint")
    return edited.withColumns(
        {
            "near_edited": likeness(fp, F.col("edited_fingerprint")),
            "near_next": likeness(fp, F.col("next_fingerprint")),
        }
    ).drop("next_fingerprint")
