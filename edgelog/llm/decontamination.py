"""Benchmark decontamination by Wu-Manber search over words.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. Windows of one length make one searcher: a table of word pairs says how far the search may jump,
pairs that end a window lead to a bucket of windows, and comparing all words confirms an occurrence.

Windows travel to the executors in blocks of at most ``block_bytes``; documents pass all blocks in turn
without a shuffle. A document that many windows hit carries its hit spans, merged, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.llm.shared import alnum_words, byte_texts, kept, prepare_workers, texts_of

SIZE = 10
BLOCK_BYTES = 8 << 20
FOUND = "doc_id bigint, text string, n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"


class WuManber:
    """Searches a list of words for windows that all have ``length`` words."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.jump, self.buckets = {}, {}

    def add(self, words: tuple[bytes, ...], item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = words[end - b : end]
            self.jump[key] = min(self.jump.get(key, m), m - end)
        self.buckets.setdefault(words[m - b :], {}).setdefault(words, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Where windows begin, and the items they are from."""
        m, b, jump, free = self.length, self.block, self.jump, self.length - self.block + 1
        end, n = m, len(words)
        while end <= n:
            key = tuple(words[end - b : end])
            step = jump.get(key, free)
            if step:
                end += step
                continue
            items = self.buckets[key].get(tuple(words[end - m : end]))
            if items:
                yield end - m, items
            end += 1


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct rows (window, item): words joined by blanks, and the item's id as text (empty if null)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = alnum_words(text)
                k = min(size, len(words))
                if k:
                    rows.update((b" ".join(words[i : i + k]), item) for i in range(len(words) - k + 1))
            windows, items = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["window", "item"]
            )

    prepare_workers(benchmark.sparkSession)
    items = benchmark.select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"),
        F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"),
    )
    return items.mapInArrow(cut, "window binary, item string").distinct()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[list[tuple[bytes, str]]]:
    """All windows with their items, in blocks of about ``block_bytes`` that are formed by hash."""
    windows = benchmark_windows(benchmark, size).withColumn("bytes", F.length("window") + F.length("item") + 64)
    windows = kept(windows)
    total = windows.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        yield [(bytes(r["window"]), r["item"]) for r in part.collect()]


def _searchers(windows: list[tuple[bytes, str]]) -> dict[int, WuManber]:
    found: dict[int, WuManber] = {}
    for window, item in windows:
        words = tuple(window.split())
        found.setdefault(len(words), WuManber(len(words))).add(words, item)
    return found


def _search_block(docs: DataFrame, windows: list[tuple[bytes, str]]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = _searchers(windows)
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            counts, all_spans, all_items = [], [], []
            known = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for text, (spans, items) in zip(byte_texts(batch.column("text")), known):
                words = alnum_words(text)
                hits, found = [(s["first"], s["last"]) for s in spans], set(items)
                for m, searcher in searchers.items():
                    for first, of in searcher.search(words):
                        hits.append((first, first + m - 1))
                        found |= of
                counts.append(len(words))
                all_spans.append([{"first": a, "last": b} for a, b in _merged(hits)])
                all_items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(counts, pa.int64()),
                    pa.array(all_spans, span),
                    pa.array(all_items, pa.list_(pa.string())),
                ],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(search, FOUND)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_words, spans (hit words, from 0, both ends in), items.

    A null text has no words. Repeated rows and null ids are kept as they are; an empty benchmark hits nothing.
    """
    found = texts_of(docs).selectExpr(
        "doc_id",
        "text",
        "0L AS n_words",
        "CAST(array() AS array<struct<first:int,last:int>>) AS spans",
        "CAST(array() AS array<string>) AS items",
    )
    for windows in _blocks(benchmark, size, block_bytes):
        found = _search_block(found, windows)
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no benchmark window occurs."""
    for windows in _blocks(benchmark, size, block_bytes):
        docs = docs.where(_clean_test(windows)(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return docs


def _clean_test(windows: list[tuple[bytes, str]]):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searchers = _searchers(windows).values()
        for texts in batches:
            words = (alnum_words(t.encode()) for t in texts)
            yield pd.Series([not any(any(True for _ in s.search(w)) for s in searchers) for w in words], dtype=bool)

    return clean


def n_hit(spans: Column) -> Column:
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)


def report(found: DataFrame) -> DataFrame:
    """The counts and the digest of the items of each document."""
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
