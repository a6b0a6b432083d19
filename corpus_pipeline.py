"""From raw documents to packed training sequences.

Each stage works on all rows that the one before has kept, and is written to the shared folder and read again, so a
lost executor costs one stage's tasks at most. All stages but the last return the columns of ``documents``:

1. quality classifier: documents that the co-trained classifier rejects go;
2. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays;
3. benchmark decontamination: documents in which a benchmark window occurs go;
4. secret scan: secrets are replaced in the texts;
5. best-fit packing: token ids in sequences of at most 4096.

Null texts count as empty: no rule but the classifier's removes them. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from edgelog.llm import decontamination, jaccard_join, packing, quality, secret_scan
from edgelog.llm.shared import kept

#: Documents whose score is below this are rejected.
REJECT_BELOW = 0.5
VOCABULARY = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, REJECT_BELOW)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fit(secret_scan.label_findings(docs)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the classifier nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
