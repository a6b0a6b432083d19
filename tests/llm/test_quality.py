"""Co-training against a plain loop over all documents, and how much a round takes."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from edgelog.llm import quality
from edgelog.llm.models import Logistic

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("crc32(CAST(doc_id AS string)) % 3 = 0").select("doc_id", "quality")


def plain_co_training(rows, known):
    """Weights of both views, and how many pseudo-labels were given; ``known`` holds labels or None."""
    train = [k for k, g in enumerate(known) if g is not None]
    text, meta = rows[:, :-3], quality.metadata_features(rows[:, -3:])
    lessons = [[(k, known[k]) for k in train], [(k, known[k]) for k in train]]
    unused = [k for k, g in enumerate(known) if g is None]
    given = 0
    for done in range(quality.ROUNDS + 1):
        views = []
        for x, lesson in zip((text, meta), lessons):
            views.append(Logistic().fit(x[[k for k, _ in lesson]], np.array([g for _, g in lesson], float)))
        if done == quality.ROUNDS:
            return views, given
        left = []
        for k in unused:
            sure = [v.predict(x[k : k + 1])[0] for v, x in zip(views, (text, meta))]
            for teacher, p in enumerate(sure):
                if p >= quality.SURE or p <= 1 - quality.SURE:
                    lessons[1 - teacher].append((k, float(p > 0.5)))
                    given += 1
                    break
            else:
                left.append(k)
        unused = left


def test_rounds_equal_a_plain_loop(tables, monkeypatch):
    monkeypatch.setattr(quality, "TAKE", 10**6)
    docs, labels = tables
    table = sorted(quality.feature_table(docs, labels).collect(), key=lambda r: (r["key"], bytes(r["row"])))
    rows = np.array([np.frombuffer(bytes(r["row"])) for r in table])
    views, given = plain_co_training(rows, [r["good"] for r in table])
    model = quality.fit(docs, labels)
    assert model.taken == given > 100
    for ours, plain in zip(model.views, views):
        np.testing.assert_allclose(ours.weights, plain.weights, rtol=1e-4, atol=1e-6)


def test_a_round_takes_a_bounded_share_of_each_source_and_none_twice(tables, monkeypatch):
    monkeypatch.setattr(quality, "TAKE", 5)
    docs, labels = tables
    table = quality.feature_table(docs, labels).cache()
    known = table.where("good IS NOT NULL").toPandas()
    rows = np.array([np.frombuffer(bytes(r)) for r in known["row"]])
    taught = [Logistic().fit(x, known["good"].to_numpy()) for x in quality._views(rows)]
    pool = quality.Pool(table.where("good IS NULL"))
    for _ in range(3):
        found, label, teacher = pool.take(taught)
        groups = Counter(zip(teacher.tolist(), label.tolist(), found[:, -3].tolist()))
        assert len(groups) > 2 and max(groups.values()) < 20 and len(found) < 5 * 2 * len(groups)
    assert len(set(pool.taken.tolist())) == len(pool.taken)


def test_repeated_rows_teach_once_and_rows_without_id_nothing(tables):
    docs, labels = tables
    once = {(r["key"], bytes(r["row"]), r["good"]) for r in quality.feature_table(docs, labels).collect()}
    many = docs.union(docs.where("doc_id % 3 = 0")).union(docs.selectExpr("NULL", *docs.columns[1:]))
    again = quality.feature_table(many, labels.union(labels)).collect()
    assert len(again) == len(once) and {(r["key"], bytes(r["row"]), r["good"]) for r in again} == once
