"""Validation of request fields. Each check gives a struct of the clean value and an error text."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgelog.functions.metadata import is_json
from edgelog.functions.text import ascii_lower, strip_ws

# They equal the gateway's.
APPROVED_HOSTS = ("dbpedia.org", "am.dbpedia.data.dice-research.org")
APPROVED_SUFFIXES = (".dbpedia.org",)
TEXT_FIELDS = {"entity": "entity id", "search": "search query", "sparql": "sparql query"}
INVALID_HASHES = {
    "entity": "invalid_entity_id",
    "search": "invalid_search_query",
    "sparql": "invalid_sparql_query",
}
LANGUAGE_ENDPOINTS = {
    "de": "https://de.dbpedia.org/sparql",
    "fr": "https://fr.dbpedia.org/sparql",
    "am": "https://am.dbpedia.data.dice-research.org/sparql",
}
ERROR_STATUS = {
    "bad_request": 400,
    "origin_error": 502,
    "origin_unavailable": 503,
    "outbound_limiter_closed": 503,
    "metrics_unavailable": 503,
}
MAX_RESPONSE_BYTES = 102_400
UNAVAILABLE_MESSAGE = "dbpedia origin is unavailable and no cached response exists"


def lookup(key: Column, table: dict) -> Column:
    """CASE over a small fixed table; null for other keys."""
    cases = [F.when(key == k, F.lit(v)) for k, v in table.items()]
    return F.coalesce(*cases)


def _checked(value: Column, error: Column) -> Column:
    return F.struct(
        F.when(error.isNull(), value).alias("value"), error.cast("string").alias("error")
    )


def _first_failure(*checks: tuple[Column, str]) -> Column:
    """Message of the first check whose condition holds; null if none does."""
    return functools.reduce(
        lambda case, check: case.when(check[0], F.lit(check[1])),
        checks[1:],
        F.when(checks[0][0], F.lit(checks[0][1])),
    )


def text_error(clean: Column, field: Column) -> Column:
    return F.when(clean == "", F.concat(field, F.lit(" is required")))


def require_text(text: Column, field: Column | str) -> Column:
    """Strip, and reject what is then empty (null counts as empty)."""
    clean = clean_text(text)
    return _checked(clean, text_error(clean, F.lit(field) if isinstance(field, str) else field))


def clean_text(text: Column) -> Column:
    return F.coalesce(strip_ws(text), F.lit(""))


def approved_host(host: Column, hosts=APPROVED_HOSTS, suffixes=APPROVED_SUFFIXES) -> Column:
    return functools.reduce(
        lambda ok, suffix: ok | host.endswith(suffix), suffixes, host.isin(*hosts)
    )


def resolved_path(path: Column) -> Column:
    """A path without dot segments (a dot may be written ``%2e``); one at the end leaves a slash.

    Most paths have none and are not taken apart.
    """
    has_dots = path.contains("/.") | F.lower(path).contains("/%2e")
    return F.when(has_dots, _without_dots(path)).otherwise(path)


def _without_dots(path: Column) -> Column:
    here, up = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        above = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        name = F.lower(segment)
        return F.when(name.isin(*here), kept).when(name.isin(*up), above).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step)
    ends_in_dots = F.lower(F.element_at(segments, -1)).isin(*here, *up)
    return F.concat(F.array_join(kept, "/"), F.when(ends_in_dots, F.lit("/")).otherwise(F.lit("")))


def url_parts(url: Column) -> dict[str, Column]:
    """The parts of a stripped URL that the endpoint check looks at."""

    def part(name: str) -> Column:
        return F.try_parse_url(url, F.lit(name))

    return {
        "scheme": ascii_lower(part("PROTOCOL")),
        "host": ascii_lower(part("HOST")),
        "port": F.regexp_extract(part("AUTHORITY"), r":([0-9]+)$", 1),
        "user": F.nullif(F.regexp_replace(part("USERINFO"), ":$", ""), F.lit("")),
        "path": resolved_path(part("PATH")),
        "has_more": F.coalesce(part("QUERY"), part("REF")).isNotNull(),
    }


# The messages of this and the other checks, and the order of the checks, equal the gateway's.
def endpoint_error(
    url: Column, parts: dict[str, Column], hosts=APPROVED_HOSTS, suffixes=APPROVED_SUFFIXES
) -> Column:
    """Message of the first failed check, in a fixed order; null passes as no override."""
    scheme, host, port = parts["scheme"], parts["host"], parts["port"]
    number = F.when(port != "", port.try_cast("bigint"))
    needs_host = scheme.isin("http", "https", "ws", "wss", "ftp")
    return _first_failure(
        (url.isNull(), None),
        (url == "", "endpoint required"),
        (
            scheme.isNull()
            | (needs_host & host.isNull())
            | ((port != "") & (number.isNull() | (number > 65535))),
            "endpoint must be a valid URL",
        ),
        (host.isNull(), "endpoint must include a host"),
        (scheme != "https", "endpoint must use https"),
        (~approved_host(host, hosts, suffixes), "endpoint must be an approved DBpedia endpoint"),
        (parts["path"] != "/sparql", "endpoint path must be /sparql"),
        (parts["has_more"], "endpoint must not include query or fragment"),
    )


def clean_endpoint(url: Column, parts: dict[str, Column]) -> Column:
    """An accepted endpoint in normal form: lower-case host, no default port."""
    number = F.when(parts["port"] != "", parts["port"].try_cast("bigint"))
    return F.when(
        url.isNotNull(),
        F.concat(
            F.lit("https://"),
            F.coalesce(F.concat(parts["user"], F.lit("@")), F.lit("")),
            parts["host"],
            F.when(number != 443, F.concat(F.lit(":"), number)).otherwise(F.lit("")),
            F.lit("/sparql"),
        ),
    )


def validate_endpoint(
    endpoint: Column, hosts=APPROVED_HOSTS, suffixes=APPROVED_SUFFIXES
) -> Column:
    """An endpoint override.

    Hosts outside ASCII and other forms ``java.net.URI`` does not take are rejected as invalid.
    """
    url = strip_ws(endpoint)
    parts = url_parts(url)
    return _checked(clean_endpoint(url, parts), endpoint_error(url, parts, hosts, suffixes))


def clean_language(lang: Column, default: str = "en") -> Column:
    return ascii_lower(strip_ws(F.coalesce(lang, F.lit(default))))


def language_error(clean: Column) -> Column:
    """Letters first, then parts of 1 to 8 letters or digits, 35 characters at most."""
    valid = clean.rlike(r"^[a-z]{1,8}(-[a-z0-9]{1,8})*$") & (F.length(clean) <= 35)
    return F.when(~valid, F.lit("lang must be a valid BCP-47-style language tag"))


def validate_language(lang: Column, default: str = "en") -> Column:
    """A language tag, lower-cased."""
    clean = clean_language(lang, default)
    return _checked(clean, language_error(clean))


def resource_iri(entity_id: Column, lang: Column) -> Column:
    """IRI of an entity: eight characters are percent-encoded, ``/`` and Unicode stay."""
    # The characters encoded; % comes first as the others add one.
    encoded = entity_id
    for character in '% <>"\\#?':
        encoded = F.replace(encoded, F.lit(character), F.lit(f"%{ord(character):02X}"))
    host = F.when(lang == "am", F.lit("am.dbpedia.org")).otherwise(F.lit("dbpedia.org"))
    return F.concat(F.lit("http://"), host, F.lit("/resource/"), encoded)


def endpoint_for(lang: Column) -> Column:
    """The endpoint offered for a language; null means the default one."""
    return lookup(lang, LANGUAGE_ENDPOINTS)


def classify_origin(status: Column, body: Column, max_bytes: int = MAX_RESPONSE_BYTES) -> Column:
    """Class of an origin response; a body of exactly ``max_bytes`` is still accepted."""
    return (
        F.when(~status.between(200, 299), F.lit("status"))
        .when(F.octet_length(body) > max_bytes, F.lit("too_large"))
        .when(~F.coalesce(is_json(body), F.lit(False)), F.lit("invalid_json"))
        .otherwise(F.lit("ok"))
    )


def origin_message(kind: Column, status: Column, max_bytes: int = MAX_RESPONSE_BYTES) -> Column:
    return (
        F.when(kind == "status", F.concat(F.lit("dbpedia returned status "), status.cast("string")))
        .when(kind == "too_large", F.lit(f"dbpedia response exceeded {max_bytes} bytes"))
        .when(kind == "invalid_json", F.lit("dbpedia returned invalid json"))
    )


def outcome_status(outcome: Column) -> Column:
    """HTTP status of an outcome code; 200 where there is no error code."""
    return F.coalesce(lookup(outcome, ERROR_STATUS), F.lit(200)).cast("smallint")
