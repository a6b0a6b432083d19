"""Token-id files of directly addressable codes.

A file has rows of segments; a segment has whole documents. Its ids are cut into chunks of 8 bits: level 0
has the lowest chunk of every id, level 1 the next chunk of those ids that have more, and so on. A bitmap for
each level says which ids go on, and a rank directory counts its ones before every ``RANK_BITS`` bits. So an id at any place
is read with one look at each of its levels, without decoding what stands before it.

Columns: ``bucket`` and ``segment`` (their order is that of the documents), ``n_tokens``, ``ids`` and
``lengths`` of the documents (little-endian 64-bit integers), ``levels``, ``more`` and ``ranks`` (one binary
for each level; the last level has empty ones, since nothing goes on). Spark's Parquet writer commits the
files, so lost executors leave no half-written ones, and they can be on any file system that Spark writes to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgelog.llm.shared import NO_ID, slices, texts_of
from edgelog.llm.tokens import TEXT_BYTES, encoder

SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512

SEGMENT = (
    "bucket int, segment bigint, n_tokens bigint, ids binary, lengths binary, "
    "levels array<binary>, more array<binary>, ranks array<binary>"
)
_BINARIES = pa.list_(pa.binary())
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), _BINARIES, _BINARIES, _BINARIES]
_NAMES = ["bucket", "segment", "n_tokens", "ids", "lengths", "levels", "more", "ranks"]


def encode_ids(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of unsigned 32-bit ids."""
    levels, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 255).astype(np.uint8).tobytes())
        goes_on = rest > 255
        if not goes_on.any():
            more.append(b""), ranks.append(b"")
            return levels, more, ranks
        bits = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.uint32)
        more.append(bits.tobytes())
        ranks.append((np.cumsum(per_block, dtype=np.uint32) - per_block).astype("<u4").tobytes())
        rest = rest[goes_on] >> 8


def decode_ids(levels: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.frombuffer(levels[-1], np.uint8).astype(np.uint32)
    for level, bitmap in zip(levels[-2::-1], more[-2::-1]):
        low = np.frombuffer(level, np.uint8)
        goes_on = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(low), bitorder="little").astype(bool)
        out = low.astype(np.uint32)
        out[goes_on] |= ids << np.uint32(8)
        ids = out
    return ids


def id_at(levels: list[bytes], more: list[bytes], ranks: list[bytes], place: int) -> int:
    """The id at one place, from one byte of each of its levels."""
    value, shift = 0, 0
    for level, bitmap, rank in zip(levels, more, ranks):
        value |= level[place] << shift
        if not bitmap or not bitmap[place >> 3] >> (place & 7) & 1:
            return value
        block = place // RANK_BITS
        before = int.from_bytes(bitmap[block * RANK_BITS // 8 : place >> 3], "little").bit_count()
        before += (bitmap[place >> 3] & ((1 << (place & 7)) - 1)).bit_count()
        place = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + before
        shift += 8
    raise ValueError("a level is missing")


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Writes the ids of all texts (null: empty), ``end_id`` after each, in ascending order of doc_id.

    Rows with the same id are ordered by a hash of their texts; rows without an id come last.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], np.uint32)
        bucket, segment, held, ids, lengths = 0, 0, [], [], []

        def closed() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            row = [bucket, segment, len(tokens), np.array(ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes()]
            row += encode_ids(tokens)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)

        for batch in slices(batches, TEXT_BYTES):
            bucket = batch.column("bucket")[0].as_py()
            found, counts = encode(batch.column("text"))
            last = np.cumsum(counts)
            for doc_id, first, n in zip(
                batch.column("doc_id").fill_null(NO_ID).to_pylist(), (last - counts).tolist(), counts.tolist()
            ):
                if lengths and sum_ + n + 1 > segment_tokens:
                    yield closed()
                    segment, held, ids, lengths = segment + 1, [], [], []
                sum_ = (sum_ if lengths else 0) + n + 1
                held += (found[first : first + n], end)
                ids.append(doc_id)
                lengths.append(n + 1)
        if lengths:
            yield closed()

    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = texts_of(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("bucket"))
    rows.mapInArrow(write, SEGMENT).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = decode_ids(row["levels"], row["more"]).astype("<u4").tobytes()
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                ids = np.frombuffer(row["ids"], "<i8")
                columns = [
                    pa.array(np.full(len(ids), row["bucket"], np.int32)),
                    pa.array(np.full(len(ids), row["segment"], np.int64)),
                    pa.array(ids, mask=ids == NO_ID),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "segment", "doc_id", "at", "n_tokens", "crc"])

    files = spark.read.schema(SEGMENT).parquet(path)
    rows = files.mapInArrow(
        read, "bucket int, segment bigint, doc_id bigint, at bigint, n_tokens bigint, crc bigint"
    ).withColumnRenamed("crc", "ids_crc32")
    return rows.join(_segment_starts(files), ["bucket", "segment"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def _segment_starts(files: DataFrame) -> DataFrame:
    """How many ids stand before each segment: sums over buckets, then within each bucket."""
    sizes = files.select("bucket", "segment", "n_tokens")
    until = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("at_segment"))
    return sizes.join(buckets, "bucket").select(
        "bucket", "segment", (F.col("bucket_start") + F.col("at_segment")).alias("before")
    )


def ids_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, place, token for every wanted (doc_id, place) that exists; place counts from 0 in the document."""

    def look(wanted: pa.Table, segments: pa.Table) -> pa.Table:
        out = []
        for row in segments.to_pylist():
            for doc_id, place, at in zip(*(wanted.column(c).to_pylist() for c in ("doc_id", "place", "at"))):
                out.append((doc_id, place, id_at(row["levels"], row["more"], row["ranks"], at + place)))
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["doc_id", "place", "token"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = (np.frombuffer(row[c], "<i8") for c in ("ids", "lengths"))
                columns = [
                    pa.array(np.full(len(ids), row["bucket"], np.int32)),
                    pa.array(np.full(len(ids), row["segment"], np.int64)),
                    *map(pa.array, (ids, np.cumsum(lengths) - lengths, lengths)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "segment", "doc_id", "at", "n"])

    files = spark.read.schema(SEGMENT).parquet(path)
    directory = files.select("bucket", "segment", "ids", "lengths").mapInArrow(
        index, "bucket int, segment bigint, doc_id bigint, at bigint, n bigint"
    )
    wanted = wanted.select(F.col("doc_id").cast("bigint"), F.col("place").cast("bigint")).where("place >= 0")
    found = directory.join(wanted, "doc_id").where("place < n").drop("n")
    touched = files.join(found.select("bucket", "segment").distinct(), ["bucket", "segment"], "left_semi")
    pairs = found.groupBy("bucket", "segment").cogroup(touched.groupBy("bucket", "segment"))
    return pairs.applyInArrow(look, "doc_id bigint, place bigint, token bigint")
