"""Quality classifier by co-training of two views of a document.

One view is the text (shape of words, repeats, letters and symbols), the other its metadata (source, language,
length). Each view's logistic regression is fitted on labelled documents. Then, round by round, the views take
unlabelled documents of which one of them is sure (probability of at least ``SURE`` or at most ``1 - SURE``) into the training
set of the other. In the end the logits of both
views are calibrated and combined by a regression: each labelled document's logits come from views that were fitted without
its part of the labels.

Every round scores all unlabelled documents. Of the sure ones that no round has taken yet it takes about ``TAKE`` for
each view, class and source slot, chosen by a hash, so that a source with most of the documents teaches no more
than another and what the driver holds is bounded whatever the input. The labelled documents are about ``LABELLED`` rows, chosen
by a hash too. Features of both views are computed once and written as a small table (about 100 bytes a document),
which all rounds read.

Nulls in any column and empty texts have features like other values. Rows of one id that are equal in both views count
once in learning; rows without id teach nothing. Several labels of one id count as the lowest. Columns beyond the views' are not
looked at. All documents are scored, also those. With fewer than ``FOLDS`` labels of a kind every document gets the share of
good labels (1 if there are none).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.llm.models import Logistic, sigmoid
from edgelog.llm.shared import buffers, hash_words, kept, prepare_workers, slices

#: About so many labelled rows are fitted on; so many pseudo-labels a round for each view, class and source slot.
LABELLED, TAKE = 20_000, 200
ROUNDS, SURE = 3, 0.97
#: Parts of the labelled rows, each of which is calibrated with views that were fitted without it.
FOLDS = 4
TEXT_FEATURES = 9
SOURCE_SLOTS, LANG_SLOTS = 64, 16

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 usual mark, 5 other symbol
_KIND[0x21:0x7F] = 5
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 2


def text_features(batch: pa.RecordBatch) -> np.ndarray:
    """A row for each text: size, letters and symbols, repeated words and word pairs (shares, smoothed)."""
    data, offsets = buffers(batch.column("text"))
    words, first = hash_words(data, offsets)
    n_docs, n = len(offsets) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    of = np.zeros((n_docs, 6))
    for kind in range(6):
        sums = np.concatenate([[0], np.cumsum(_KIND[data] == kind)])
        of[:, kind] = sums[offsets[1:]] - sums[offsets[:-1]]
    letters, size = of[:, 1] + of[:, 2], of[:, 1:].sum(axis=1)

    def repeats(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, owner))
        same = (np.diff(values[order]) == 0) & (np.diff(owner[order]) == 0) if len(order) > 1 else np.zeros(0, bool)
        return np.bincount(owner[order][1:][same] if len(order) > 1 else owner[:0], minlength=n_docs)

    beside = (np.diff(doc) == 0) if len(doc) > 1 else np.zeros(0, bool)
    pair_doc = doc[:-1][beside] if len(doc) > 1 else doc[:0]
    pairs = (words[:-1] * np.uint64(3) + words[1:])[beside] if len(doc) > 1 else words[:0]
    stutter = np.bincount(pair_doc[(words[:-1] == words[1:])[beside]] if len(doc) > 1 else doc[:0], minlength=n_docs)
    return np.column_stack(
        [
            np.log1p(n),
            size / (n + 1),
            of[:, 5] / (size + 10),
            np.maximum(of[:, 1] - 2 - 0.3 * n, 0) / (letters + 10),
            of[:, 3] / (size + 10),
            of[:, 4] / (size + 10),
            repeats(words, doc) / (n + 20),
            repeats(pairs, pair_doc) / (n + 20),
            stutter / (n + 5),
        ]
    )


def metadata_codes(batch: pa.RecordBatch) -> np.ndarray:
    """A row for each document: slots of source and language, logarithm of the length."""
    columns = (("source", SOURCE_SLOTS), ("lang", LANG_SLOTS))
    codes = [[zlib.crc32((v or "").encode()) % slots for v in batch.column(c).to_pylist()] for c, slots in columns]
    length = np.maximum(batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False), 0)
    return np.column_stack([*np.array(codes, float).reshape(2, -1), np.log1p(length)])


def metadata_features(codes: np.ndarray) -> np.ndarray:
    """Source and language as hashed indicators, and the logarithm of the length."""
    rows = np.arange(len(codes))
    out = np.zeros((len(codes), SOURCE_SLOTS + LANG_SLOTS + 2))
    out[rows, codes[:, 0].astype(int)] = 1
    out[rows, SOURCE_SLOTS + codes[:, 1].astype(int)] = 1
    out[:, -2], out[:, -1] = codes[:, 2], codes[:, 2] ** 2
    return out


def _views(rows: np.ndarray) -> list[np.ndarray]:
    """Features of the text and of the metadata, from rows of text features and codes."""
    return [rows[:, :-3], metadata_features(rows[:, -3:])]


def _matrix(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist())).reshape(len(rows), TEXT_FEATURES + 3)


_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64()]


def _view_columns(docs: DataFrame) -> dict[str, Column]:
    """The columns that the views use; missing ones count as null, a null text as empty."""
    prepare_workers(docs.sparkSession)

    def column(name: str, kind: str) -> Column:
        return (docs[name] if name in docs.columns else F.lit(None)).cast(kind)

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return {
        "doc_id": column("doc_id", "bigint"),
        "text": text,
        "source": column("source", "string"),
        "lang": column("lang", "string"),
        "n_chars": column("n_chars", "bigint"),
    }


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(c.alias(name) for name, c in _view_columns(docs).items()))


class CoTrained:
    """Two views and their combination; ``share`` is used alone where there was nothing to learn from."""

    def __init__(self, share: float):
        self.share, self.views, self.joint, self.taken = share, None, None, 0

    def fit(self, rows: np.ndarray, y: np.ndarray, fold: np.ndarray, take: Callable) -> CoTrained:
        """rows, y: labelled documents; ``fold`` says in which of the ``FOLDS`` calibrations each is left out.

        ``take`` finds sure unlabelled documents for the two views of a round: rows, pseudo-labels, and which view is sure.
        """
        x = _views(rows)
        given = [([v[:0]], [y[:0]]) for v in x]
        for done in range(ROUNDS + 1):
            self.views = self._fitted(x, y, given)
            if done == ROUNDS:
                break
            found, label, teacher = take(self.views)
            self.taken += len(found)
            for k, features in enumerate(_views(found)):
                given[k][0].append(features[teacher != k])
                given[k][1].append(label[teacher != k])
        logits = np.zeros((len(y), 2))
        for part in range(FOLDS):
            out = fold == part
            views = self._fitted([v[~out] for v in x], y[~out], given)
            logits[out] = np.column_stack([view.logit(v[out]) for view, v in zip(views, x)])
        self.joint = Logistic(0.1).fit(logits, y)
        return self

    @staticmethod
    def _fitted(x: list[np.ndarray], y: np.ndarray, given: list[tuple]) -> list[Logistic]:
        """Each view fitted on labelled documents and the pseudo-labels that the other one gave it."""
        return [Logistic().fit(np.concatenate([v, *g]), np.concatenate([y, *p])) for v, (g, p) in zip(x, given)]

    def _logits(self, x: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([view.logit(v) for view, v in zip(self.views, x)])

    def predict(self, x: list[np.ndarray]) -> np.ndarray:
        """Columns: combined score, score of the text, score of the metadata."""
        if self.joint is None:
            return np.full((len(x[0]), 3), self.share)
        logits = self._logits(x)
        return np.column_stack([self.joint.predict(logits), sigmoid(logits)])


def _by_hash(rows: DataFrame, seed: int, size: int, of: Column) -> DataFrame:
    """About ``size`` of ``of`` rows by a hash of their key, all if there are fewer."""
    return rows.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) * of < size * 1_000_000)


def feature_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, row (text features and metadata codes as doubles), good (null without a label); repeated rows once."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.column_stack([text_features(batch), metadata_codes(batch)])
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], ["doc_id", "row"])

    rows = _columns(docs).where("doc_id IS NOT NULL").mapInArrow(features, "doc_id bigint, row binary")
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["quality"].cast("double").alias("good"))
    known = known.where("doc_id IS NOT NULL AND good IN (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = rows.dropDuplicates(["doc_id", "row"]).join(known, "doc_id", "left")
    return rows.select(F.xxhash64("doc_id", "row").alias("key"), "row", "good")


class Pool:
    """The unlabelled rows of a feature table; every round looks at all of them that were not taken before."""

    def __init__(self, rows: DataFrame):
        self.rows, self.taken, self.round = rows, np.zeros(0, np.int64), 0

    def take(self, views: list[Logistic]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, pseudo-labels and the sure view of about ``TAKE`` documents a view, class and source slot."""
        taken = self.taken

        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column("row"))
                free = ~np.isin(batch.column("key").to_numpy(), taken)
                for k, (view, x) in enumerate(zip(views, _views(rows))):
                    p = view.predict(x)
                    at = np.flatnonzero(free & ((p >= SURE) | (p <= 1 - SURE)))
                    free[at] = False
                    group = (2 * k + (p[at] > 0.5)) * SOURCE_SLOTS + rows[at, -3].astype(np.int64)
                    found = batch.select(["key", "row"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(group)], ["key", "row", "of"])

        found = self.rows.select("key", "row").mapInArrow(sure, "key bigint, row binary, of bigint")
        counts = [0] * (4 * SOURCE_SLOTS)
        for r in found.groupBy("of").count().collect():
            counts[r["of"]] = r["count"]
        self.round += 1
        some = _by_hash(found, self.round, TAKE, F.get(F.lit(counts), F.col("of").cast("int")))
        chosen = some.toPandas().sort_values(["key", "row"])
        self.taken = np.concatenate([taken, chosen["key"].to_numpy(np.int64)])
        kind = chosen["of"].to_numpy(np.int64) // SOURCE_SLOTS
        return _matrix(pa.array(chosen["row"], pa.binary())), (kind % 2).astype(float), kind // 2


def folds(y: np.ndarray) -> np.ndarray:
    """Deals the rows of each label to ``FOLDS`` folds in turn, so that each has its share of the rarer one."""
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    return fold


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """A model from ``labels`` (doc_id, quality 0 or 1; other rows count for nothing) and unlabelled documents."""
    table = kept(feature_table(docs, labels))
    known = table.where("good IS NOT NULL")
    some = _by_hash(known, 11, LABELLED, F.lit(known.count())).toPandas().sort_values(["key", "row"])
    y, rows = some["good"].to_numpy(float), _matrix(pa.array(some["row"], pa.binary()))
    model = CoTrained(float(y.mean()) if len(y) else 1.0)
    if min((y == 0).sum(), (y == 1).sum()) < FOLDS:
        return model
    return model.fit(rows, y, folds(y), Pool(table.where("good IS NULL")).take)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score, text_score, metadata_score for every row of ``docs``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.predict([text_features(batch), metadata_features(metadata_codes(batch))])
            columns = [batch.column("doc_id"), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "text_score", "metadata_score"])

    return _columns(docs).mapInArrow(
        scored, "doc_id bigint, score double, text_score double, metadata_score double"
    )


def keep_good(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``.

    The score is a value of a document's own columns, so rows that are equal in those of both views stay or go
    together, and no key has to be unique.
    """

    @F.pandas_udf("boolean")
    def good(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        columns = [pa.array(c, from_pandas=True, type=t) for c, t in zip((text, source, lang, n_chars), _TYPES)]
        whole = pa.RecordBatch.from_arrays(columns, ["text", "source", "lang", "n_chars"])
        scores = [model.predict([text_features(b), metadata_features(metadata_codes(b))])[:, 0] for b in slices(iter([whole]))]
        return pd.Series(np.concatenate(scores) >= threshold if scores else [], dtype=bool)

    views = _view_columns(docs)
    return docs.where(good(*(views[c] for c in ("text", "source", "lang", "n_chars"))))
