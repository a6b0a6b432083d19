from __future__ import annotations

from pyspark.sql import functions as F

from edgelog.functions import metadata
from edgelog.operators import popular
from edgelog.schemas import REQUEST_LOGS
from edgelog.sources import logs as log_store

TEXTS = [
    '{"entity_id":"A","lang":"de","endpoint":null}',
    '{"entity_id":null}',
    '{"entity_id":"A"}',
    '{"entity_id":7,"lang":""}',
    '{"entity_id":{"x":[1,"b"]}}',
    '{"entity_id":"\\u00e9 \\"q\\""}',
    "{}",
    "[1]",
    '"entity_id"',
]


def rows(spark, texts):
    logs = [(i, 100 * i, "entity" if i % 5 else "search", "k", True, False, 1, "c", 200, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(logs, REQUEST_LOGS)


def test_typed_metadata_reads_as_text_does(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "metadata string")
    both = df.withColumn("v", metadata.typed(F.col("metadata")))
    for key in ("entity_id", "lang", "endpoint", "missing"):
        for found in both.select(
            metadata.has_key(F.col("metadata"), key), metadata.typed_has_key(F.col("v"), key),
            metadata.meta(F.col("metadata"), key), metadata.typed_meta(F.col("v"), key), "metadata",
        ).collect():
            assert found[0] == bool(found[1]) and found[2] == found[3], found


def test_text_that_is_no_json_has_no_typed_metadata(spark):
    texts = ["{", "", '{"a":1,"a":2}', "nope"]
    df = spark.createDataFrame([(t,) for t in texts], "metadata string")
    typed = df.select(metadata.typed(F.col("metadata")).alias("v")).collect()
    assert [r.v for r in typed] == [None] * 4


def test_hits_of_a_typed_log_are_read_without_parsing(spark, tmp_path):
    logs, path = rows(spark, TEXTS * 3), str(tmp_path / "log")
    written = log_store.with_typed_metadata(logs)
    assert written._jdf.queryExecution().optimizedPlan().toString().count("VariantExpressionEvalUtils") == 1
    log_store.append_request_logs(written, path)
    hits = popular.entity_hits(log_store.open_logs(spark, path, typed_metadata=True))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "parse" not in plan.lower() and "json_tuple" not in plan and "get_json_object" not in plan
    key = lambda r: str(tuple(r))
    assert sorted(hits.collect(), key=key) == sorted(popular.entity_hits(logs).collect(), key=key)
