"""Toxic passages as maximum-scoring segments of token log-odds.

1. Learn: in labelled documents, words and their beginnings (3 to 7 characters) are counted by class. The log-odds of
   a token under an informative Dirichlet prior (its share in both classes together, worth ``PRIOR`` tokens, and half a token), divided by
   their standard error, say which tokens speak for toxicity (``MIN_Z``, ``MIN_ODDS``, ``MIN_COUNT`` texts). A word's score is the log-odds of the
   most certain of its tokens; all other words share one negative score.
2. Search: one linear scan finds all maximal segments of positive score of a document (every one, not the best alone).
3. Calibrate: extreme-value theory gives the number of segments of a score that clean text of a length would show by
   chance, E = K n exp(-lambda s); lambda solves the sum of p(s) exp(lambda s) = 1 over clean words, K is counted. Segments with
   E up to ``MAX_E`` are significant. A logistic regression on the best and the summed significance of a document gives
   its score between 0 and 1.

Fitting uses about ``SAMPLE`` labelled rows, chosen by a hash of their ids, and never the ids, sources, languages or labels of
the documents that are scored. Without labels of both kinds the score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.models import Logistic
from edgelog.llm.shared import alnum_words, slices, texts_of

SAMPLE = 20_000
PRIOR = 1_000.0
MIN_Z, MIN_ODDS, MIN_COUNT = 4.0, 1.5, 6
BEGINNINGS = range(3, 8)
NEUTRAL = -0.15
MAX_E = 0.05
MEMORY_WORDS = 500_000


def words_of(text: str) -> list[bytes]:
    return alnum_words(text.lower().encode())


def tokens_of(word: bytes) -> list[bytes]:
    """A word (marked by a blank) and its beginnings of some characters."""
    text = word.decode("utf-8", "replace")
    return [b" " + word, *(text[:k].encode() for k in BEGINNINGS if len(text) >= k)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in order, by one scan with a stack.

    A segment is maximal if each of its beginnings and ends adds to its score and no such segment around it does better.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    breaks = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum with it
    for first, last in zip(at[breaks].tolist(), at[np.append(breaks[1:], len(at)) - 1].tolist()):
        low, high = float(total[first]), float(total[last + 1])
        while True:
            # the nearest earlier segment that begins lower; those in between have no more to offer
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, low, high))
    return [(a, b, high - low) for a, b, low, high in stack]


class Toxicity:
    """Token scores, calibration and the final regression."""

    def __init__(self, share: float = 0.0):
        self.share, self.tokens, self.slope, self.level, self.final = share, {}, 1.0, 1.0, None
        self.words: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}}

    def word_score(self, word: bytes) -> float:
        found = [self.tokens[t] for t in tokens_of(word) if t in self.tokens]
        return max(found)[1] if found else NEUTRAL

    def scores(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > MEMORY_WORDS:
            self.words = {}
        for word in set(words).difference(self.words):
            self.words[word] = self.word_score(word)
        return np.array(list(map(self.words.__getitem__, words)), float)

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Segments with their significance, minus the logarithm of E (positive and larger: rarer by chance)."""
        expected = np.log(self.level * max(len(words), 1))
        return [(a, b, self.slope * s - expected) for a, b, s in segments(self.scores(words))]

    @staticmethod
    def summary(passages: list[tuple[int, int, float]], n_words: int) -> list[float]:
        best = max((s for *_, s in passages), default=-10.0)
        strong = sum(max(s, 0.0) for *_, s in passages)
        return [min(max(best, -10.0), 40.0), np.log1p(strong), float(not passages)]

    def predict(self, rows: list[list[float]]) -> np.ndarray:
        if self.final is None or not rows:
            return np.full(len(rows), self.share)
        return self.final.predict(np.array(rows))


def _count(docs: DataFrame) -> DataFrame:
    """token, toxic, clean: how many texts of either label have a word with the token (a text that repeats one
    word a thousand times says no more about it than any other)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = words[label]
                for word in set(words_of(text)):
                    own[word] = own.get(word, 0) + 1
            found: dict[bytes, list[int]] = {}
            for label, own in enumerate(words):
                for word, n in own.items():
                    for token in tokens_of(word):
                        found.setdefault(token, [0, 0])[label] += n
            clean, toxic = zip(*found.values()) if found else ((), ())
            columns = [pa.array(list(found), pa.binary()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["token", "toxic", "clean"])

    counts = docs.mapInArrow(count, "token binary, toxic bigint, clean bigint")
    return counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """A model from ``labels`` (doc_id, toxic 0 or 1; other rows count for nothing) of documents."""
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) * n < sample * 1_000_000)
    rows = texts_of(docs).join(F.broadcast(known), "doc_id").select("toxic", "text")  # about ``sample`` rows at most
    counts = _count(rows)
    n_toxic, n_clean = counts.where(F.substring("token", 1, 1) == b" ").agg(F.sum("toxic"), F.sum("clean")).first()
    model = Toxicity(float(rows.agg(F.avg("toxic")).first()[0] or 0.0))
    if not n_toxic or not n_clean:
        return model
    prior = (F.col("toxic") + F.col("clean")) * (PRIOR / (n_toxic + n_clean)) + 0.5
    y, x = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y / (n_toxic + PRIOR - y)) - F.log(x / (n_clean + PRIOR - x))
    scored = counts.select("token", "toxic", odds.alias("odds"), (odds / F.sqrt(1 / y + 1 / x)).alias("z"))
    # only tokens that speak for toxicity; their number is bounded by the size of the sample
    kept = scored.where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS) & (F.col("toxic") >= MIN_COUNT)).collect()
    model.tokens = {bytes(r["token"]): (round(r["z"], 9), min(r["odds"], 8.0)) for r in kept}
    _calibrate(model, rows)
    return model


def _calibrate(model: Toxicity, rows: DataFrame) -> None:
    """Lambda, K and the regression, from the segments of the sample (a few numbers for each text)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                scores = model.scores(words)
                found = [s for *_, s in segments(scores)]
                out.append((label, len(words), scores[scores > 0].tolist(), found))
            types = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            names = ["toxic", "n", "positive", "segments"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "toxic int, n bigint, positive array<double>, segments array<double>"
    seen = sorted(rows.mapInArrow(look, schema).collect())
    clean = [r for r in seen if not r["toxic"]]
    n = sum(r["n"] for r in clean)
    positive = np.array([s for r in clean for s in r["positive"]])
    share = (n - len(positive)) / max(n, 1)

    def excess(slope: float) -> float:
        return share * np.exp(slope * NEUTRAL) + np.exp(slope * positive).sum() / max(n, 1) - 1

    low, high = 0.0, 3.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.slope = max(low, 0.05)
    chance = [s for r in clean for s in r["segments"]]
    # K so that clean text shows as many segments as counted; half a segment is added to be safe
    weight = np.mean([np.exp(-model.slope * s) for s in chance]) if chance else np.exp(-model.slope * 4.0)
    model.level = (len(chance) + 0.5) / max(n, 1) / weight
    x, y = [], []
    for r in seen:
        expected = np.log(model.level * max(r["n"], 1))
        found = [(0, 0, model.slope * s - expected) for s in r["segments"]]
        x.append(model.summary(found, r["n"]))
        y.append(r["toxic"])
    model.final = Logistic(0.5).fit(np.array(x), np.array(y, float))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, and ``passages``: the significant segments (first and last word, significance)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("first", "last", "significance")
        shape = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("significance", pa.float64())]))
        least = -np.log(MAX_E)
        for batch in slices(batches):
            rows, passages = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = model.passages(words)
                rows.append(model.summary(found, len(words)))
                passages.append([dict(zip(names, p)) for p in found if p[2] >= least])
            columns = [batch.column("doc_id"), pa.array(model.predict(rows)), pa.array(passages, shape)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "passages"])

    schema = "doc_id bigint, score double, passages array<struct<first:int,last:int,significance:double>>"
    return texts_of(docs).mapInArrow(scored, schema)
