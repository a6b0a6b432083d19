"""Gateway tables derived from the given test tables (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.functions import keys
from edgelog.functions.validate import INVALID_HASHES, endpoint_for, lookup, resource_iri
from edgelog.operators.triples import ABSTRACT, LABEL
from edgelog.schemas import CACHE_ENTRIES, REQUEST_LOGS, TRIPLES

EXTRA_SECONDS = 21_600
ONTOLOGY = "http://dbpedia.org/ontology/"
RESOURCE = "http://dbpedia.org/resource/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
DATE = "http://www.w3.org/2001/XMLSchema#date"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Whole seconds of a zone-less timestamp read as UTC, in any session zone.
EPOCH_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def detailed_logs(events: DataFrame) -> DataFrame:
    """Log rows with the helper columns ``k``, ``user_id``, ``event_type``, ``lang``, ``endpoint``, ``resource``."""
    rows = events.selectExpr(
        "event_id AS id",
        f"{EPOCH_SECONDS} AS observed_at_unix_secs",
        "user_id",
        "event_type",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CAST(floor(value) AS INT) AS latency_ms",
        "array('en', 'de', 'fr', 'am', 'es')[CAST(user_id % 5 AS INT)] AS lang",
    ).selectExpr(
        "*",
        """CASE WHEN event_type IN ('view', 'click') THEN 'entity' WHEN event_type = 'purchase' THEN 'search'
           WHEN event_type = 'signup' THEN 'sparql' ELSE array('entity', 'search', 'sparql')[k % 3] END AS route""",
        """CAST(CASE WHEN event_type != 'error' OR k % 4 = 0 THEN 200 WHEN k % 4 = 1 THEN 400
           WHEN k % 4 = 2 THEN 502 ELSE 503 END AS SMALLINT) AS status_code""",
        "event_type = 'error' AND k % 4 = 0 AS stale",
        "sha2(concat('user_', user_id), 256) AS client_hash",
    )
    rows = rows.withColumn("endpoint", endpoint_for(F.col("lang"))).selectExpr(
        "*",
        "stale OR (event_type != 'error' AND k % 10 < 6) AS cache_hit",
        """CASE route WHEN 'entity' THEN concat('Doc_', k) WHEN 'search' THEN concat('query ', k)
           ELSE concat('SELECT * WHERE { ?s ?p ?o } LIMIT ', k) END AS resource""",
    )
    key = keys.request_key(F.col("route"), F.col("resource"), F.col("lang"), F.col("endpoint"))
    return rows.select(
        "*",
        F.when(F.col("status_code") == 400, lookup(F.col("route"), INVALID_HASHES))
        .otherwise(key)
        .alias("query_hash"),
        F.expr(
            """CASE WHEN route = 'entity' AND status_code = 200 AND NOT stale THEN to_json(
               struct(resource AS entity_id, lang, endpoint), map('ignoreNullFields', 'false')) ELSE '{}' END"""
        ).alias("metadata"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed_logs(table(spark, sf_dir, "events"))


def request_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select(*REQUEST_LOGS.fieldNames())


def latest(rows: DataFrame) -> Column:
    """The last observed second, as a scalar subquery."""
    return rows.agg(F.max("observed_at_unix_secs")).scalar()


def good_answers(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("status_code") == 200) & ~F.col("stale"))


def cache_entries(rows: DataFrame) -> DataFrame:
    """One entry per key that was answered."""
    at = F.col("observed_at_unix_secs")
    return (
        good_answers(rows)
        .groupBy(F.col("query_hash").alias("cache_key"))
        .agg(
            F.min(at).alias("created_at_unix_secs"),
            (F.count(F.lit(1)) - 1).alias("hit_count"),
            (F.max(at) + EXTRA_SECONDS).alias("expires_at_unix_secs"),
        )
        .withColumns(
            {
                "payload": F.concat(F.lit('{"key":"'), F.col("cache_key"), F.lit('"}')),
                "last_success_unix_secs": F.col("created_at_unix_secs"),
            }
        )
        .select(*CACHE_ENTRIES.fieldNames())
    )


def origin_responses(entries: DataFrame) -> DataFrame:
    """One response per entry; status and body follow from the key's first two digits."""
    first, second = F.substr("cache_key", F.lit(1), F.lit(1)), F.substr("cache_key", F.lit(2), F.lit(1))
    return entries.select(
        "cache_key",
        F.when(first == "0", 429).when(first.isin("1", "2"), 502).otherwise(200).alias("status"),
        F.when(second == "0", F.lit("{"))
        .when(second == "1", F.repeat(F.lit("x"), F.lit(102_401)))
        .when(second == "2", F.lit('{"again":1,"again":2}'))
        .otherwise(F.col("payload"))
        .alias("body"),
    )


def origin_calls(rows: DataFrame) -> DataFrame:
    """Calls that reached the origin, with their outcome."""
    called = rows.where((~F.col("cache_hit") | F.col("stale")) & (F.col("status_code") != 400))
    return called.select(
        "endpoint",  # null for the default one
        F.col("observed_at_unix_secs").alias("ts"),
        F.col("id").alias("seq"),
        (~((F.col("status_code") >= 500) | F.col("stale"))).alias("ok"),
    )


def requests(rows: DataFrame) -> DataFrame:
    """Requests as they would have been sent, with untidy and some invalid fields."""
    k, user = F.col("k"), F.col("user_id")
    rejected, click = F.col("status_code") == 400, F.col("event_type") == "click"
    resource = F.when(rejected & (k % 12 == 1), F.lit(" \t ")).when(
        F.col("route") == "sparql",
        F.replace(F.col("resource"), F.lit(" "), F.lit("\n  ")),
    ).otherwise(F.concat(F.lit("\t"), F.col("resource"), F.lit(" ")))
    endpoint = F.when(rejected & (k % 12 == 5), F.lit("http://de.dbpedia.org/sparql")).when(
        click, F.concat(F.lit(" "), F.replace(F.col("endpoint"), F.lit("https"), F.lit("HTTPS")), F.lit("\n"))
    ).otherwise(F.col("endpoint"))
    lang = F.when(rejected & (k % 12 == 9), F.lit("de_DE")).when(
        F.col("lang") != "en", F.when(click, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang"))
    )
    address = F.when(user % 3 == 0, F.create_map(F.lit("x-real-ip"), F.concat(F.lit("10.0.0."), user))).when(
        user % 3 == 1,
        F.create_map(
            F.lit("x-forwarded-for"), F.concat(F.lit(" , 10.1.0."), user, F.lit(", 10.2.0.1"))
        ),
    ).otherwise(F.create_map(F.lit("x-real-ip"), F.lit("  ")))
    return rows.select(
        F.col("id").alias("request_id"),
        "route",
        resource.alias("resource"),
        lang.alias("lang"),
        endpoint.alias("endpoint"),
        address.alias("headers"),
        "observed_at_unix_secs",
        "latency_ms",
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about every document, from whole texts; assessed documents have more of them."""
    assessed = F.col("quality").isNotNull()
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    birth = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("n_chars") % 20_000).cast("int"))

    def fact(keep, predicate, object, kind, lang=None, datatype=None):
        return F.when(
            keep,
            F.struct(
                F.lit(predicate).alias("predicate"),
                object.cast("string").alias("object"),
                F.lit(kind).alias("object_kind"),
                (lang if isinstance(lang, Column) else F.lit(lang).cast("string")).alias("lang"),
                F.lit(datatype).cast("string").alias("datatype"),
            ),
        )

    text, doc = F.col("text"), F.col("doc_id")
    facts = F.array(
        fact(F.lit(True), LABEL, text, "literal", F.col("lang")),
        fact(F.lit(True), LABEL, F.concat(F.lit("Doc "), doc, F.lit(" (de)")), "literal", "de"),
        fact(assessed, ABSTRACT, text, "literal", F.col("lang")),
        fact(good, ONTOLOGY + "birthDate", birth, "literal", None, DATE),
        fact(good, ONTOLOGY + "birthPlace", F.concat(F.lit(RESOURCE), F.col("n_name")), "uri"),
        fact(assessed, ONTOLOGY + "knownFor", F.concat(F.lit(RESOURCE), F.col("source")), "uri"),
        fact(toxic, ONTOLOGY + "knownFor", F.concat(F.lit("topic "), doc), "literal", "en"),
        fact(F.lit(True), TYPE, F.lit(ONTOLOGY + "Person"), "uri"),
    )
    documents = table(spark, sf_dir, "documents")
    # The 25 nations are the same at every scale.
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(
        F.broadcast(nations), F.col("n_nationkey") == F.col("n_chars") % 25, "left"
    )
    return rows.select(
        F.concat(F.lit(RESOURCE + "Doc_"), doc).alias("subject"),
        F.explode(F.filter(facts, lambda f: f.isNotNull())).alias("fact"),
    ).select("subject", "fact.*").select(*TRIPLES.fieldNames())


def entity_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its own language and in German, and every entity the log asks for."""
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit(RESOURCE + "Doc_"), F.col("doc_id")).alias("subject"),
        F.explode(F.array(F.col("lang"), F.lit("de"))).alias("lang"),
    )
    asked = good_answers(logs(spark, sf_dir)).where(F.col("route") == "entity")
    return documents.unionByName(
        asked.select(resource_iri(F.col("resource"), F.col("lang")).alias("subject"), "lang")
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text and three short ones (two are wildcards to LIKE), in four languages."""
    short = spark.sql("SELECT * FROM VALUES (-1L, 'EAU'), (-2L, '%'), (-3L, '_') AS t(item_id, text)")
    texts = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(short)
    languages = F.array(*[F.lit(code) for code in ("en", "de", "fr", "es")])
    return texts.withColumn("lang", F.explode(languages)).withColumn(
        "query_id", F.concat_ws("/", F.col("item_id").cast("string"), "lang")
    )


def endpoint_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One endpoint text per page: good, untidy, wrong in each way, or the page's own address."""
    shape = F.col("page_id") % 12
    texts = {
        0: "https://de.dbpedia.org/sparql",
        1: " https://FR.dbpedia.org/sparql ",
        2: "http://dbpedia.org/sparql",
        3: "https://dbpedia.org/other",
        4: "https://dbpedia.org/sparql?query=x",
        5: "not a url",
        6: "  ",
        9: "https://dbpedia.org/./sparql",
        10: "https://@DBpedia.org/a/../sparql",
        11: "https://dbpedia.org/sparql/.",
    }
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(shape == 8, F.col("url")).otherwise(lookup(shape, texts)).alias("endpoint")
    )
