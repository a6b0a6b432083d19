from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgelog.functions import keys, metadata, validate
from edgelog.functions.text import normalize_ws, strip_ws
from edgelog.operators import requests as req

ALLOWED = "https://am.dbpedia.data.dice-research.org/sparql"


def model_key(salt, *parts):
    digest = hashlib.sha256(salt.encode())
    for part in parts:
        digest.update(len(part.encode()).to_bytes(8, "big") + part.encode())
    return digest.hexdigest()


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def params(*pairs):
    return F.array(*[keys.param(k, F.lit(v)) for k, v in pairs])


def test_known_keys(spark):
    def key(namespace, resource, *pairs):
        return keys.cache_key(F.lit(namespace), F.lit(resource), params(*pairs))

    plain, swapped, other, amharic = one(
        spark,
        key("entity", "Entity_38", ("lang", "en")),
        key("entity", "Entity_38", ("lang", "en"), ("endpoint", "x")),
        key("search", "Entity_38", ("lang", "en")),
        key("entity", "ሰላም", ("lang", "am"), ("endpoint", ALLOWED)),
    )
    assert plain == "0cb091b3af5fd766730eea8e956b5b532ecc0e28f191028404f64964fccc95d9"
    assert swapped == model_key("cache-key-v1", "entity", "Entity_38", "endpoint=x&lang=en")
    assert other not in (plain, swapped)
    assert amharic == model_key("cache-key-v1", "entity", "ሰላም", f"endpoint={ALLOWED}&lang=am")


def test_raw_queries_share_a_key_whatever_their_whitespace(spark):
    def key(route, text, lang="en"):
        return keys.request_key(F.lit(route), F.lit(text), F.lit(lang), F.lit(None).cast("string"))

    a, b, c, d, e = one(
        spark,
        key("sparql", "ASK { ?a <b> 'c' }"),
        key("sparql", "  ASK\n{ ?a\t<b>   'c' } ", "de"),
        key("sparql", "ASK { ?a <b> 'd' }"),
        key("search", "a b"),
        key("search", "a  b"),
    )
    assert a == b == model_key("cache-key-v1", "sparql", "ASK { ?a <b> 'c' }", "lang=raw")
    assert a != c and d != e


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.text(st.characters(blacklist_categories=["Cs"]), max_size=40),
    st.lists(st.tuples(st.sampled_from("abAé"), st.text("xyZß&=", max_size=4)), max_size=5),
)
def test_keys_follow_the_model(spark, resource, pairs):
    rows = spark.createDataFrame(
        [(resource, [{"k": k, "v": v} for k, v in pairs])], "r string, p array<struct<k:string,v:string>>"
    )
    found = rows.select(keys.cache_key(F.lit("entity"), F.col("r"), F.col("p"), "salt")).first()[0]
    canonical = "&".join(f"{k}={v}" for k, v in sorted(pairs, key=lambda p: (p[0].encode(), p[1].encode())))
    assert found == model_key("salt", "entity", resource, canonical)


def test_client_identifier(spark):
    cases = {
        "192.0.2.77": {"x-real-ip": " 192.0.2.77", "x-forwarded-for": "192.0.2.1"},
        "192.0.2.8": {"x-forwarded-for": "192.0.2.8 ,192.0.2.9,192.0.2.10"},
        "192.0.2.4": {"x-real-ip": " , ", "x-forwarded-for": " ,\t192.0.2.4"},
        "unknown": {"x-other": "192.0.2.5"},
        "192.0.2.6": {"x-real-ip": "bücher", "x-forwarded-for": "192.0.2.6"},
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "want string, headers map<string,string>")
    client = keys.client_identifier(F.col("headers"))
    for row in rows.select("want", client.alias("got"), keys.hash_client(client).alias("hash")).collect():
        assert row.got == row.want
        assert row.hash == hashlib.sha256(row.want.encode()).hexdigest()


def test_unicode_whitespace(spark):
    text = " \u0085a  　b\n"
    assert one(spark, strip_ws(F.lit(text)), normalize_ws(F.lit(text))) == ("a  　b", "a b")


def endpoint(spark, text):
    checked = validate.validate_endpoint(F.lit(text).cast("string"))
    return tuple(spark.range(1).select(checked.alias("c")).select("c.value", "c.error").first())


def test_endpoints(spark):
    good = {
        "https://de.dbpedia.org/sparql": "https://de.dbpedia.org/sparql",
        f" {ALLOWED} ": ALLOWED,
        "HTTPS://DBpedia.org:443/sparql": "https://dbpedia.org/sparql",
        "https://me@fr.dbpedia.org:8443/sparql": "https://me@fr.dbpedia.org:8443/sparql",
    }
    for text, value in good.items():
        assert endpoint(spark, text) == (value, None), text
    dots = ("https://dbpedia.org/./sparql", "https://@dbpedia.org/a/../sparql", "https://dbpedia.org/a/%2E%2e/sparql")
    for text in (*dots, "https://:@dbpedia.org/sparql", "https://dbpedia.org/../sparql"):
        assert endpoint(spark, text) == ("https://dbpedia.org/sparql", None), text
    assert endpoint(spark, "https://me:@dbpedia.org/sparql") == ("https://me@dbpedia.org/sparql", None)
    assert endpoint(spark, "https://dbpedia.org/sparql/.") == (None, "endpoint path must be /sparql")
    assert endpoint(spark, None) == (None, None)
    bad = {
        " ": "endpoint required",
        "not a url": "endpoint must be a valid URL",
        "dbpedia.org/sparql": "endpoint must be a valid URL",
        "https://dbpedia.org:70000/sparql": "endpoint must be a valid URL",
        "mailto:a@dbpedia.org": "endpoint must include a host",
        "http://example.com/x?y": "endpoint must use https",
        "https://example.com/sparql": "endpoint must be an approved DBpedia endpoint",
        "https://evildbpedia.org/sparql": "endpoint must be an approved DBpedia endpoint",
        "https://dbpedia.org/sparql/": "endpoint path must be /sparql",
        "https://dbpedia.org/sparql?": "endpoint must not include query or fragment",
        "https://dbpedia.org/sparql#": "endpoint must not include query or fragment",
    }
    for text, error in bad.items():
        assert endpoint(spark, text) == (None, error), text


def test_languages(spark):
    def language(text):
        checked = validate.validate_language(F.lit(text).cast("string"))
        return spark.range(1).select(checked.alias("c")).select("c.value", "c.error").first()

    for text, value in {None: "en", " DE ": "de", "zh-Hant-1": "zh-hant-1", "a" * 8: "a" * 8}.items():
        assert language(text).value == value
    for text in ("de_DE", "", "K", "a" * 9, "1a", "de-", "-de", "aa-" + "b-" * 17 + "b"):
        assert language(text).error is not None and language(text).value is None


def test_resource_iri(spark):
    iris = one(
        spark,
        validate.resource_iri(F.lit("x y/z  w"), F.lit("en")),
        validate.resource_iri(F.lit('100%<>"\\#?'), F.lit("de")),
        validate.resource_iri(F.lit("ሰላም_1"), F.lit("am")),
    )
    assert iris == (
        "http://dbpedia.org/resource/x%20y/z%20%20w",
        "http://dbpedia.org/resource/100%25%3C%3E%22%5C%23%3F",
        "http://am.dbpedia.org/resource/ሰላም_1",
    )


def test_json_is_one_whole_value(spark):
    good = ['{"a":1,"a":[2]}', '{"a":{"b":1,"b":2}}', "[" * 60 + "]" * 60, "1e400", '{"a":[1]}', "1", '"x"', " null ", "[]"]
    bad = ["", " ", "{", "{} {}", "1,2", '1,"b":2', "1],[2", "1},{", "nul", "{'a':1}", "NaN", "{a:1}"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string")
    accepted = {r.t for r in rows.where(metadata.is_json(F.col("t"))).collect()}
    assert accepted == set(good)


def test_a_key_with_a_null_value_exists(spark):
    text = F.lit('{"endpoint":null}')
    found = one(
        spark, metadata.has_key(text, "endpoint"), metadata.has_key(text, "lang"), metadata.meta(text, "endpoint")
    )
    assert found == (True, False, None)


REQUESTS = (
    "request_id long, route string, resource string, lang string, endpoint string, "
    "headers map<string,string>, observed_at_unix_secs long, latency_ms long"
)


def make_requests(spark):
    return spark.createDataFrame(
        [
            (1, "entity", " A ", None, None, {}, 5, 7),
            (2, "search", " ", "de_DE", "bad", {}, 5, 7),
            (3, "entity", "A", "en", "https://example.com/sparql", {}, 5, 7),
            (4, "entity", "A", "de_DE", None, {}, 5, 7),
            (5, "sparql", "ASK {}", "de_DE", None, {}, 5, 2**40),
        ],
        REQUESTS,
    )


def test_split_valid(spark):
    valid, rejected = req.split_valid(make_requests(spark))
    assert {(r.request_id, r.resource, r.lang) for r in valid.collect()} == {(1, "A", "en"), (5, "ASK {}", "raw")}
    assert {(r.request_id, r.error_message, r.invalid_hash, r.status_code) for r in rejected.collect()} == {
        (2, "search query is required", "invalid_search_query", 400),
        (3, "endpoint must be an approved DBpedia endpoint", None, 400),
        (4, "lang must be a valid BCP-47-style language tag", None, 400),
    }


def test_log_rows(spark):
    valid, rejected = req.split_valid(make_requests(spark))
    answered = req.with_keys(valid).withColumns(
        {
            "source": F.when(F.col("route") == "entity", F.lit("cache")),
            "error_code": F.when(F.col("route") == "sparql", F.lit("origin_error")),
        }
    )
    rows = {r.id: r for r in req.to_log_rows(answered.unionByName(rejected, allowMissingColumns=True)).collect()}
    assert set(rows) == {1, 2, 5}
    assert rows[1].metadata == '{"entity_id":"A","lang":"en","endpoint":null}' and rows[1].cache_hit
    assert (rows[2].query_hash, rows[2].status_code, rows[2].metadata) == ("invalid_search_query", 400, "{}")
    assert (rows[5].status_code, rows[5].cache_hit, rows[5].latency_ms) == (502, False, 2**31 - 1)
