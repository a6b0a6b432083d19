"""Canonical cache keys and client pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgelog.functions.text import normalize_ws, strip_ws

DEFAULT_SALT = "cache-key-v1"


def param(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("v"))


def canonical_params(params: Column) -> Column:
    """``array<struct<k,v>>`` to ``k=v&k=v``, ordered by key and then value, nothing escaped."""
    pairs = F.transform(F.array_sort(params), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    return F.array_join(pairs, "&")


def request_params(route: Column, lang: Column, endpoint: Column) -> Column:
    """Canonical parameters of a request: the endpoint if one is set, and the language.

    A raw query has no language of its own, so its key always says ``raw``. The two names are known,
    so their order is too, and no array has to be sorted per row.
    """
    key_lang = F.when(route == "sparql", F.lit("raw")).otherwise(lang)
    chosen = F.concat(F.lit("endpoint="), endpoint, F.lit("&"))
    return F.concat(F.coalesce(chosen, F.lit("")), F.lit("lang="), key_lang)


def key_resource(route: Column, resource: Column) -> Column:
    """Only the text of a raw query is whitespace-normalised; ids and search text are kept."""
    return F.when(route == "sparql", normalize_ws(resource)).otherwise(resource)


def _length_prefixed(part: Column) -> Column:
    length = F.unhex(F.lpad(F.hex(F.octet_length(part).cast("bigint")), 16, "0"))
    return F.concat(length, F.encode(part, "utf-8"))


def digest_key(namespace: Column, resource: Column, params: Column, salt: str = DEFAULT_SALT) -> Column:
    """SHA-256 over the salt and three texts, each led by its length as 8 big-endian bytes."""
    parts = [_length_prefixed(p) for p in (namespace, resource, params)]
    return F.sha2(F.concat(F.encode(F.lit(salt), "utf-8"), *parts), 256)


def cache_key(
    namespace: Column, resource: Column, params: Column, salt: str = DEFAULT_SALT
) -> Column:
    """Key of a resource with any parameters, given as ``array<struct<k,v>>``."""
    return digest_key(namespace, resource, canonical_params(params), salt)


def request_key(
    route: Column, resource: Column, lang: Column, endpoint: Column, salt: str = DEFAULT_SALT
) -> Column:
    """The cache key of a validated request."""
    params = request_params(route, lang, endpoint)
    return digest_key(route, key_resource(route, resource), params, salt)


def _first_forwarded(header: Column) -> Column:
    # A header with anything but printable ASCII and tabs is read as absent.
    readable = F.when(header.rlike(r"^[\x20-\x7E\t]*$"), header)
    parts = F.transform(F.split(readable, ","), strip_ws)
    return F.get(F.filter(parts, lambda p: p != ""), F.lit(0))


def client_identifier(headers: Column) -> Column:
    """The caller's address from lower-case header names: real-ip, forwarded-for, ``unknown``."""
    return F.coalesce(
        _first_forwarded(F.try_element_at(headers, F.lit("x-real-ip"))),
        _first_forwarded(F.try_element_at(headers, F.lit("x-forwarded-for"))),
        F.lit("unknown"),
    )


def hash_client(client: Column) -> Column:
    """Pseudonym that is written instead of the address: unsalted SHA-256 in hex."""
    return F.sha2(client, 256)
