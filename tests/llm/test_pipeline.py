"""The registered queries at the smallest scale, and each stage of the pipeline against a plain model."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from brute import hits, near_duplicates
from odd import documents
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as registered  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_oracles import compare, connect  # noqa: E402
from edgelog.llm.registered import ORACLES, QUERIES  # noqa: E402
from edgelog.llm.shared import kept  # noqa: E402

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r'token = "([0-9a-fA-F]{40})"', re.IGNORECASE)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) == ""


def test_join_against_all_pairs(spark):
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op2_jaccard_join"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found == near_duplicates(texts)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, after = docs.schema, []
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, SF))
        after.append(docs)
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in after[:4]]
    assert all(d.schema == schema for d in after[:4])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = sum((i in texts[0]) == (q == 1) for i, q in labels.items())
    assert right / len(labels) > 0.95 and all(i in texts[0] for i, q in labels.items() if q == 1)
    assert set(texts[1]) == {i for i, (first, _) in near_duplicates(texts[0]).items() if i == first}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts[2]) == {i for i, (_, hit, _) in hits(texts[1], items).items() if not hit}
    assert texts[3] == {i: TOKEN.sub(lambda m: m[0].replace(m[1], "[SECRET]"), t) for i, t in texts[2].items()}
    rows = after[4].toPandas().sort_values(["doc_id", "piece"])
    whole = rows.groupby("doc_id")["ids"].apply(lambda parts: b"".join(map(bytes, parts))).to_dict()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {i: encode(t, add_special_tokens=False).ids + [1] for i, t in texts[3].items()}
    assert whole == {i: np.array(x, "<u4").tobytes() for i, x in ids.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_stages_of_odd_and_empty_documents(spark, odd):
    for docs in (odd, documents(spark, []), documents(spark, [(None, None), (1, "a"), (1, "a")])):
        columns, n = docs.columns, docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = kept(stage(spark, docs, SF))
            assert docs.columns == columns or k == 4
            assert docs.count() <= n or k == 4
