"""DuckDB SQL that gives the same results as the registered queries, written on its own.

Fixed values: messages, placeholders, hashes, IRIs, endpoints and limits in it equal the gateway's.
"""

# One row per event with every column of the log and the helpers it is made from.
LOGS = """
base AS (
  SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS observed_at_unix_secs, user_id, event_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS latency_ms,
    ['en','de','fr','am','es'][CAST(user_id % 5 AS INTEGER) + 1] AS lang
  FROM events),
routed AS (
  SELECT *,
    CASE lang WHEN 'de' THEN 'https://de.dbpedia.org/sparql' WHEN 'fr' THEN 'https://fr.dbpedia.org/sparql'
      WHEN 'am' THEN 'https://am.dbpedia.data.dice-research.org/sparql' END AS endpoint,
    CASE WHEN event_type IN ('view','click') THEN 'entity' WHEN event_type = 'purchase' THEN 'search'
      WHEN event_type = 'signup' THEN 'sparql' ELSE ['entity','search','sparql'][k % 3 + 1] END AS route,
    CAST(CASE WHEN event_type <> 'error' OR k % 4 = 0 THEN 200 WHEN k % 4 = 1 THEN 400
      WHEN k % 4 = 2 THEN 502 ELSE 503 END AS SMALLINT) AS status_code,
    event_type = 'error' AND k % 4 = 0 AS stale
  FROM base),
named AS (
  SELECT *,
    stale OR (event_type <> 'error' AND k % 10 < 6) AS cache_hit,
    CASE route WHEN 'entity' THEN 'Doc_' || k WHEN 'search' THEN 'query ' || k
      ELSE 'SELECT * WHERE { ?s ?p ?o } LIMIT ' || k END AS resource,
    CASE WHEN endpoint IS NULL THEN '' ELSE 'endpoint=' || endpoint || '&' END || 'lang=' ||
      CASE WHEN route = 'sparql' THEN 'raw' ELSE lang END AS params,
    sha256('user_' || user_id) AS client_hash
  FROM routed),
logs AS (
  SELECT *,
    CASE WHEN status_code = 400 THEN CASE route WHEN 'entity' THEN 'invalid_entity_id'
        WHEN 'search' THEN 'invalid_search_query' ELSE 'invalid_sparql_query' END
      ELSE sha256(encode('cache-key-v1') || unhex(printf('%016x', strlen(route))) || encode(route)
        || unhex(printf('%016x', strlen(resource))) || encode(resource)
        || unhex(printf('%016x', strlen(params))) || encode(params)) END AS query_hash,
    CASE WHEN route = 'entity' AND status_code = 200 AND NOT stale THEN
      '{"entity_id":"' || resource || '","lang":"' || lang || '","endpoint":' ||
      CASE WHEN endpoint IS NULL THEN 'null' ELSE '"' || endpoint || '"' END || '}' ELSE '{}' END AS metadata
  FROM named),
latest AS (SELECT max(observed_at_unix_secs) AS as_of FROM logs)"""

LOG_COLUMNS = (
    "id, observed_at_unix_secs, route, query_hash, cache_hit, stale, latency_ms, client_hash, "
    "status_code, metadata"
)

ENTRIES = """
entries AS (
  SELECT query_hash AS cache_key, '{"key":"' || query_hash || '"}' AS payload,
    min(observed_at_unix_secs) AS created_at_unix_secs, min(observed_at_unix_secs) AS last_success_unix_secs,
    count(*) - 1 AS hit_count, max(observed_at_unix_secs) + 21600 AS expires_at_unix_secs
  FROM logs WHERE status_code = 200 AND NOT stale GROUP BY query_hash),
responses AS (
  SELECT cache_key,
    CASE substr(cache_key, 1, 1) WHEN '0' THEN 429 WHEN '1' THEN 502 WHEN '2' THEN 502 ELSE 200 END AS status,
    CASE substr(cache_key, 2, 1) WHEN '0' THEN '{' WHEN '1' THEN repeat('x', 102401)
      WHEN '2' THEN '{"again":1,"again":2}' ELSE payload END AS body
  FROM entries),
classes AS (
  SELECT cache_key, status, body,
    CASE WHEN status < 200 OR status > 299 THEN 'status'
      WHEN octet_length(encode(body)) > 102400 THEN 'too_large'
      WHEN NOT json_valid(body) THEN 'invalid_json' ELSE 'ok' END AS origin_class
  FROM responses)"""

# Requests with untidy fields, and which check rejects them.
REQUESTS = """
checked AS (
  SELECT *, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id WHEN user_id % 3 = 1 THEN '10.1.0.' || user_id
      ELSE 'unknown' END AS client,
    CASE WHEN status_code <> 400 THEN NULL WHEN k % 12 = 1 THEN 'text' WHEN k % 12 = 5 THEN 'endpoint'
      WHEN k % 12 = 9 AND route <> 'sparql' THEN 'lang' END AS rejected_for,
    CASE route WHEN 'entity' THEN 'entity id' WHEN 'search' THEN 'search query' ELSE 'sparql query' END AS field,
    CASE route WHEN 'entity' THEN 'invalid_entity_id' WHEN 'search' THEN 'invalid_search_query'
      ELSE 'invalid_sparql_query' END AS placeholder
  FROM logs),
keyed AS (
  SELECT *, sha256(encode('cache-key-v1') || unhex(printf('%016x', strlen(route))) || encode(route)
        || unhex(printf('%016x', strlen(resource))) || encode(resource)
        || unhex(printf('%016x', strlen(params))) || encode(params)) AS cache_key
  FROM checked WHERE rejected_for IS NULL)"""

RESOLVED = """
resolved AS (
  SELECT k.id AS request_id, k.*, e.payload, c.body, c.origin_class, c.status,
    CASE WHEN e.expires_at_unix_secs >= as_of THEN 'cache' WHEN c.origin_class = 'ok' THEN 'origin'
      WHEN e.cache_key IS NOT NULL THEN 'stale_cache' END AS source
  FROM keyed k CROSS JOIN latest LEFT JOIN entries e USING (cache_key) LEFT JOIN classes c USING (cache_key)),
answers AS (
  SELECT request_id, cache_key,
    CASE source WHEN 'origin' THEN body WHEN 'cache' THEN payload WHEN 'stale_cache' THEN payload END AS data,
    CASE WHEN source IS NULL THEN NULL ELSE source <> 'origin' END AS cached,
    CASE WHEN source IS NULL THEN NULL ELSE source = 'stale_cache' END AS stale,
    source,
    CASE WHEN source IS NOT NULL THEN NULL WHEN origin_class IS NULL THEN 'origin_unavailable'
      ELSE 'origin_error' END AS error_code,
    CASE WHEN source IS NOT NULL THEN NULL
      WHEN origin_class IS NULL THEN 'dbpedia origin is unavailable and no cached response exists'
      WHEN origin_class = 'status' THEN 'dbpedia returned status ' || status
      WHEN origin_class = 'too_large' THEN 'dbpedia response exceeded 102400 bytes'
      ELSE 'dbpedia returned invalid json' END AS error_message,
    CAST(CASE WHEN source IS NOT NULL THEN 200 WHEN origin_class IS NULL THEN 503 ELSE 502 END AS SMALLINT)
      AS status_code
  FROM resolved)"""

TRIPLES = """
facts AS (
  SELECT d.*, l.quality, l.toxic, n.n_name, 'http://dbpedia.org/resource/Doc_' || d.doc_id AS subject
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN nation n ON n.n_nationkey = d.n_chars % 25),
triples AS (
  SELECT subject, 'http://www.w3.org/2000/01/rdf-schema#label' AS predicate, text AS object,
    'literal' AS object_kind, lang, CAST(NULL AS VARCHAR) AS datatype FROM facts
  UNION ALL SELECT subject, 'http://www.w3.org/2000/01/rdf-schema#label', 'Doc ' || doc_id || ' (de)',
    'literal', 'de', NULL FROM facts
  UNION ALL SELECT subject, 'http://dbpedia.org/ontology/abstract', text, 'literal', lang, NULL FROM facts
    WHERE quality IS NOT NULL
  UNION ALL SELECT subject, 'http://dbpedia.org/ontology/birthDate',
    CAST(DATE '1900-01-01' + CAST(n_chars % 20000 AS INTEGER) AS VARCHAR), 'literal', NULL,
    'http://www.w3.org/2001/XMLSchema#date' FROM facts WHERE quality = 1
  UNION ALL SELECT subject, 'http://dbpedia.org/ontology/birthPlace', 'http://dbpedia.org/resource/' || n_name,
    'uri', NULL, NULL FROM facts WHERE quality = 1
  UNION ALL SELECT subject, 'http://dbpedia.org/ontology/knownFor', 'http://dbpedia.org/resource/' || source,
    'uri', NULL, NULL FROM facts WHERE quality IS NOT NULL
  UNION ALL SELECT subject, 'http://dbpedia.org/ontology/knownFor', 'topic ' || doc_id, 'literal', 'en', NULL
    FROM facts WHERE toxic = 1
  UNION ALL SELECT subject, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type',
    'http://dbpedia.org/ontology/Person', 'uri', NULL, NULL FROM facts)"""

# Every combination of label, abstract and fact of the asked entities, numbered.
LOOKUP = """
asked AS (
  SELECT 'http://dbpedia.org/resource/Doc_' || doc_id AS subject, lang FROM documents
  UNION SELECT 'http://dbpedia.org/resource/Doc_' || doc_id, 'de' FROM documents
  UNION SELECT 'http://' || CASE WHEN lang = 'am' THEN 'am.' ELSE '' END || 'dbpedia.org/resource/' || resource, lang
    FROM logs WHERE status_code = 200 AND NOT stale AND route = 'entity'),
found AS (
  SELECT a.subject, a.lang, l.object AS label, b.object AS abstract, f.predicate AS property, f.object AS value,
    row_number() OVER (PARTITION BY a.subject, a.lang ORDER BY l.object NULLS FIRST, b.object NULLS FIRST,
      f.predicate NULLS FIRST, f.object NULLS FIRST) AS place
  FROM asked a
  LEFT JOIN triples l ON l.subject = a.subject AND l.lang = a.lang
    AND l.predicate = 'http://www.w3.org/2000/01/rdf-schema#label'
  LEFT JOIN triples b ON b.subject = a.subject AND b.lang = a.lang
    AND b.predicate = 'http://dbpedia.org/ontology/abstract'
  LEFT JOIN triples f ON f.subject = a.subject AND f.predicate IN ('http://dbpedia.org/ontology/birthDate',
    'http://dbpedia.org/ontology/deathDate', 'http://dbpedia.org/ontology/birthPlace',
    'http://dbpedia.org/ontology/knownFor'))"""

SEARCH = """
terms AS (
  SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'EAU' UNION ALL SELECT -2, '%' UNION ALL SELECT -3, '_'),
queries AS (
  SELECT item_id || '/' || lang AS query_id, item_id, lower(text) AS needle, lang
  FROM terms CROSS JOIN (SELECT unnest(['en','de','fr','es']) AS lang)),
matched AS (
  SELECT q.query_id, q.item_id, l.subject AS entity, l.object AS label, b.object AS abstract,
    row_number() OVER (PARTITION BY q.query_id ORDER BY l.subject, l.object, b.object NULLS FIRST) AS place
  FROM queries q
  JOIN triples l ON l.lang = q.lang AND l.predicate = 'http://www.w3.org/2000/01/rdf-schema#label'
    AND contains(lower(l.object), q.needle)
  LEFT JOIN triples b ON b.subject = l.subject AND b.lang = q.lang
    AND b.predicate = 'http://dbpedia.org/ontology/abstract')"""

HITS = """
hits AS (
  SELECT json_extract_string(metadata, '$.entity_id') AS entity_id, query_hash,
    coalesce(json_extract_string(metadata, '$.lang'), 'en') AS lang,
    json_extract_string(metadata, '$.endpoint') AS endpoint, count(*) AS hits
  FROM logs WHERE route = 'entity' AND metadata LIKE '%"entity_id"%' GROUP BY ALL)"""

WARM = """
popular AS (SELECT * FROM hits ORDER BY hits DESC, entity_id, query_hash, lang, endpoint NULLS FIRST LIMIT 25),
targets AS (
  SELECT *, 'http://' || CASE WHEN lang = 'am' THEN 'am.' ELSE '' END || 'dbpedia.org/resource/' || entity_id AS subject
  FROM popular),
payloads AS (
  SELECT t.query_hash, coalesce('[' || string_agg(
    '{"label":' || coalesce(CAST(to_json(label) AS VARCHAR), 'null')
    || ',"abstract":' || coalesce(CAST(to_json(abstract) AS VARCHAR), 'null')
    || ',"property":' || coalesce(CAST(to_json(property) AS VARCHAR), 'null')
    || ',"value":' || coalesce(CAST(to_json(value) AS VARCHAR), 'null') || '}', ',' ORDER BY place)
    FILTER (label IS NOT NULL OR abstract IS NOT NULL OR property IS NOT NULL) || ']', '[]') AS payload
  FROM targets t JOIN found f ON f.subject = t.subject AND f.lang = t.lang AND f.place <= 50
  GROUP BY t.query_hash)"""

CALLS = """
calls AS (
  SELECT coalesce(endpoint, 'https://dbpedia.org/sparql') AS endpoint, observed_at_unix_secs AS ts, id AS seq,
    NOT (status_code >= 500 OR stale) AS ok
  FROM logs WHERE (NOT cache_hit OR stale) AND status_code <> 400),
runs AS (
  SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY ts, seq
    ROWS UNBOUNDED PRECEDING) AS run, lag(ts) OVER (PARTITION BY endpoint ORDER BY ts, seq) AS previous_ts
  FROM calls),
placed AS (
  SELECT *, CASE WHEN ok THEN NULL ELSE row_number() OVER (PARTITION BY endpoint, run, ok ORDER BY ts, seq) END AS nth
  FROM runs),
counted AS (
  SELECT *, CASE WHEN ok THEN coalesce(lag(nth) OVER (PARTITION BY endpoint ORDER BY ts, seq), 0)
    ELSE nth - 1 END AS before
  FROM placed)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _rank(fraction: str, values: str = "latency_ms") -> str:
    return (
        f"coalesce(CAST(list_sort(list({values}))[greatest(CAST(ceil(CAST(count(*) AS DOUBLE) * "
        f"CAST({fraction} AS DOUBLE)) AS BIGINT), 1)] AS BIGINT), 0)"
    )


def _rate(condition: str) -> str:
    return (
        f"CASE WHEN count(*) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(count(*) FILTER ({condition}) AS DOUBLE)"
        " / CAST(count(*) AS DOUBLE) END"
    )


FAILED = "status_code >= 500 AND NOT stale"
RATES = f"""{_rate("cache_hit")} AS cache_hit_rate, {_rate("stale")} AS stale_response_rate"""
COUNTS = f"""count(*) AS total_requests, count(*) FILTER (cache_hit) AS cache_hits,
  count(*) FILTER (stale) AS stale_responses, count(*) FILTER ({FAILED}) AS origin_errors"""
P95 = f"{_rank('0.95')} AS p95_latency_ms"


def _summary(window: int, offset: int = 0, ranks: str = P95) -> str:
    return _with(LOGS) + f"""
SELECT CAST({window} AS BIGINT) AS rolling_window_seconds, {COUNTS}, {RATES},
  {_rate(FAILED)} AS origin_error_rate, {ranks}
FROM (SELECT l.* FROM logs l, latest WHERE observed_at_unix_secs >= as_of + {offset} - {window})"""


POINTS = f"""
points AS (
  SELECT CAST(3600 AS BIGINT) AS bucket_seconds, observed_at_unix_secs // 3600 * 3600 AS observed_at_unix_secs,
    count(*) AS total_requests, {RATES}, {P95}
  FROM logs GROUP BY 2)"""


def _timeseries(window: int) -> str:
    return _with(LOGS) + f"""
SELECT CAST({window} AS BIGINT) AS rolling_window_seconds, CAST(3600 AS BIGINT) AS bucket_seconds,
  observed_at_unix_secs // 3600 * 3600 AS observed_at_unix_secs, count(*) AS total_requests, {RATES}, {P95}
FROM (SELECT l.* FROM logs l, latest WHERE observed_at_unix_secs >= as_of - {window})
GROUP BY 3"""


def _transitions(threshold: int, cooldown: int) -> str:
    return _with(LOGS, CALLS) + f"""
, judged AS (
  SELECT *, before >= {threshold} AS tripped,
    before >= {threshold} AND ts - previous_ts >= {cooldown} AS cooled FROM counted)
SELECT endpoint, seq, previous_ts + {cooldown} AS at_unix_secs, 'open' AS from_state, 'half_open' AS to_state
FROM judged WHERE cooled
UNION ALL SELECT endpoint, seq, ts, CASE WHEN cooled THEN 'half_open' ELSE 'closed' END, 'open'
FROM judged WHERE NOT ok AND (cooled OR nth = {threshold})
UNION ALL SELECT endpoint, seq, ts, CASE WHEN cooled THEN 'half_open' ELSE 'open' END, 'closed'
FROM judged WHERE ok AND tripped"""


def _lifetimes(ttl: int) -> str:
    return f"""
accesses AS (
  SELECT query_hash AS cache_key, observed_at_unix_secs AS t,
    CASE WHEN t - lag(t) OVER (PARTITION BY query_hash ORDER BY t, id) <= {ttl} THEN 0 ELSE 1 END AS opens, id
  FROM (SELECT *, observed_at_unix_secs AS t FROM logs WHERE status_code = 200 AND NOT stale)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY cache_key ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS lifetime FROM accesses),
lifetimes AS (
  SELECT cache_key, min(t) AS created_at_unix_secs, max(t) AS last_access_unix_secs, count(*) - 1 AS hit_count
  FROM numbered GROUP BY cache_key, lifetime)"""


TRIPLE_ORDER = ", ".join(
    f"{c} NULLS FIRST" for c in ("subject", "predicate", "object", "object_kind", "lang", "datatype")
)

ORACLES = {
    "scan_request_logs": _with(LOGS) + """
SELECT observed_at_unix_secs, cache_hit, stale, latency_ms, status_code
FROM logs, latest WHERE observed_at_unix_secs >= as_of - 86400""",
    "log_narrowing": _with(LOGS) + """
SELECT id, CAST(least(CAST(latency_ms AS BIGINT) * 20000000, 2147483647) AS INTEGER) AS latency_ms,
  CAST(least(CAST(status_code AS INTEGER) * 100, 32767) AS SMALLINT) AS status_code FROM logs""",
    "window_filter": _with(LOGS) + """
SELECT id, observed_at_unix_secs FROM logs, latest WHERE observed_at_unix_secs >= as_of - 604800""",
    "json_key_exists": _with(LOGS) + """
SELECT id, list_contains(json_keys(metadata), 'entity_id') AS has_entity_id,
  list_contains(json_keys(metadata), 'endpoint') AS has_endpoint,
  json_extract_string(metadata, '$.endpoint') IS NOT NULL AS endpoint_is_set FROM logs""",
    "metadata_fields": _with(LOGS) + """
SELECT id, json_extract_string(metadata, '$.entity_id') AS entity_id,
  coalesce(json_extract_string(metadata, '$.lang'), 'en') AS lang,
  json_extract_string(metadata, '$.endpoint') AS endpoint FROM logs""",
    "metrics_summary_24h": _summary(86_400),
    "metrics_summary_7d": _summary(604_800),
    "metrics_summary_empty": _summary(86_400, 604_800),
    "metrics_percentiles": _summary(
        31_536_000,
        ranks=f"{_rank('0.5')} AS p50_latency_ms, {P95}, {_rank('0.99')} AS p99_latency_ms",
    ),
    "metrics_timeseries": _timeseries(86_400),
    "metrics_timeseries_7d": _timeseries(604_800),
    "timeseries_filled": _with(LOGS) + f"""
, down AS (
  SELECT observed_at_unix_secs // 3600 * 3600 AS b, count(*) AS n, {RATES}, {P95}
  FROM logs WHERE status_code = 503 GROUP BY 1)
SELECT hours.b AS observed_at_unix_secs, coalesce(n, 0) AS total_requests, coalesce(cache_hit_rate, 0) AS cache_hit_rate,
  coalesce(stale_response_rate, 0) AS stale_response_rate, coalesce(p95_latency_ms, 0) AS p95_latency_ms
FROM (SELECT unnest(range(min(b), max(b) + 1, 3600)) AS b FROM down) hours LEFT JOIN down USING (b)""",
    "busiest_hour": _with(LOGS, POINTS) + """
SELECT observed_at_unix_secs, total_requests FROM points ORDER BY total_requests DESC, observed_at_unix_secs LIMIT 1""",
    "latest_hour": _with(LOGS, POINTS) + """
SELECT observed_at_unix_secs, total_requests FROM points ORDER BY observed_at_unix_secs DESC LIMIT 1""",
    "summary_json": _with(
        LOGS, "summary AS (" + _summary(604_800).replace(_with(LOGS), "") + ")"
    )
    + "SELECT CAST(to_json(summary) AS VARCHAR) AS json FROM summary",
    "timeseries_json": f"""
WITH series AS ({_timeseries(604_800)})
SELECT '{{"rolling_window_seconds":604800,"bucket_seconds":3600,"points":' || coalesce(CAST(to_json(list(
  {{'observed_at_unix_secs': observed_at_unix_secs, 'total_requests': total_requests, 'cache_hit_rate': cache_hit_rate,
   'stale_response_rate': stale_response_rate, 'p95_latency_ms': p95_latency_ms}} ORDER BY observed_at_unix_secs))
  AS VARCHAR), '[]') || '}}' AS json FROM series""",
    "percent_label": _with(LOGS, POINTS) + """
SELECT observed_at_unix_secs, CAST(CAST(floor(cache_hit_rate * 100 + 0.5) AS INTEGER) AS VARCHAR) || '%' AS cache_hits,
  '0%' AS nothing FROM points""",
    "display_labels": _with(LOGS) + """
SELECT id, format('{:,}', observed_at_unix_secs) AS number_label,
  strftime(make_timestamp(observed_at_unix_secs * 1000000), '%H:%M') AS bucket_label,
  CAST(octet_length(encode(metadata)) AS BIGINT) AS payload_bytes FROM logs""",
    "canonical_params": _with(LOGS) + """
SELECT id, 'Route=' || route || '&endpoint=' || coalesce(endpoint, '') || '&k=' ||
  least(CAST(k AS VARCHAR), CAST(k * 7 % 100 AS VARCHAR)) || '&k=' ||
  greatest(CAST(k AS VARCHAR), CAST(k * 7 % 100 AS VARCHAR)) || '&lang=' || lang AS params FROM logs""",
    "cache_keys": _with(LOGS, REQUESTS) + "SELECT id AS request_id, cache_key FROM keyed",
    "normalize_query_ws": r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents""",
    "client_identifier": _with(LOGS, REQUESTS) + "SELECT id AS request_id, client FROM checked",
    "client_hash": _with(LOGS, REQUESTS) + """
SELECT id AS request_id, sha256(client) AS client_hash FROM checked""",
    "validate_text": _with(LOGS, REQUESTS) + """
SELECT id AS request_id,
  CASE WHEN rejected_for = 'text' THEN NULL
    WHEN route = 'sparql' THEN replace(resource, ' ', chr(10) || '  ') ELSE resource END AS value,
  CASE WHEN rejected_for = 'text' THEN field || ' is required' END AS error FROM checked""",
    "validate_endpoint": r"""
WITH given AS (
  SELECT page_id, trim(CASE page_id % 12 WHEN 0 THEN 'https://de.dbpedia.org/sparql'
    WHEN 1 THEN ' https://FR.dbpedia.org/sparql ' WHEN 2 THEN 'http://dbpedia.org/sparql'
    WHEN 3 THEN 'https://dbpedia.org/other' WHEN 4 THEN 'https://dbpedia.org/sparql?query=x'
    WHEN 5 THEN 'not a url' WHEN 6 THEN '  ' WHEN 8 THEN url WHEN 9 THEN 'https://dbpedia.org/./sparql'
    WHEN 10 THEN 'https://@DBpedia.org/a/../sparql' WHEN 11 THEN 'https://dbpedia.org/sparql/.' END) AS u FROM pages),
parts AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme,
    lower(regexp_extract(u, '^[A-Za-z]+://@?([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1),
      '/\./', '/'), '/[^/]+/\.\./', '/'), '/\.$', '/') AS path FROM given),
judged AS (
  SELECT *, CASE WHEN u IS NULL THEN NULL WHEN u = '' THEN 'endpoint required'
    WHEN scheme = '' OR host = '' THEN 'endpoint must be a valid URL'
    WHEN scheme <> 'https' THEN 'endpoint must use https'
    WHEN host NOT IN ('dbpedia.org', 'am.dbpedia.data.dice-research.org') AND NOT suffix(host, '.dbpedia.org')
      THEN 'endpoint must be an approved DBpedia endpoint'
    WHEN path <> '/sparql' THEN 'endpoint path must be /sparql'
    WHEN contains(u, '?') OR contains(u, '#') THEN 'endpoint must not include query or fragment' END AS error
  FROM parts)
SELECT page_id, CASE WHEN error IS NULL AND u IS NOT NULL THEN 'https://' || host || path END AS value, error
FROM judged""",
    "validate_language": _with(LOGS, REQUESTS) + """
, tags AS (
  SELECT id, 'request' AS kind, CASE WHEN status_code = 400 AND k % 12 = 9 THEN 'de_de' ELSE lang END AS tag FROM checked
  UNION ALL SELECT doc_id, 'document', lang || '-' || source || '-' || n_chars FROM documents)
SELECT id, kind, CASE WHEN contains(tag, '_') THEN NULL ELSE tag END AS value,
  CASE WHEN contains(tag, '_') THEN 'lang must be a valid BCP-47-style language tag' END AS error FROM tags""",
    "request_quarantine": _with(LOGS, REQUESTS) + """
SELECT id AS request_id, 'bad_request' AS error_code,
  CASE rejected_for WHEN 'text' THEN field || ' is required' WHEN 'endpoint' THEN 'endpoint must use https'
    ELSE 'lang must be a valid BCP-47-style language tag' END AS error_message,
  CAST(400 AS SMALLINT) AS status_code,
  CASE WHEN rejected_for = 'text' THEN placeholder END AS invalid_hash
FROM checked WHERE rejected_for IS NOT NULL""",
    "resource_iri": r"""
WITH given AS (
  SELECT page_id AS id, 'en' AS lang, 'http://dbpedia.org/resource/' AS base, url AS resource FROM pages
  UNION ALL SELECT doc_id, 'am', 'http://am.dbpedia.org/resource/', text FROM documents)
SELECT id, lang, base || replace(replace(replace(replace(replace(replace(replace(replace(resource,
  '%', '%25'), ' ', '%20'), '<', '%3C'), '>', '%3E'), '"', '%22'), '\', '%5C'), '#', '%23'), '?', '%3F') AS iri
FROM given""",
    "endpoint_for_lang": _with(LOGS) + "SELECT id, endpoint FROM logs",
    "cache_fresh_view": _with(LOGS, ENTRIES) + """
SELECT entries.* FROM entries, latest WHERE expires_at_unix_secs >= as_of""",
    "cache_upsert": _with(LOGS, ENTRIES) + """
, fetched AS (
  SELECT query_hash AS cache_key, '{"id":' || id || '}' AS payload, observed_at_unix_secs AS t FROM logs
  WHERE status_code = 200 AND NOT stale AND NOT cache_hit),
last AS (SELECT * FROM fetched QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY t DESC, payload DESC) = 1)
SELECT cache_key, payload, t AS created_at_unix_secs, t AS last_success_unix_secs, CAST(0 AS BIGINT) AS hit_count,
  t + 604800 AS expires_at_unix_secs FROM last
UNION ALL SELECT * FROM entries WHERE cache_key NOT IN (SELECT cache_key FROM last)""",
    "cache_record_hits": _with(LOGS, ENTRIES) + """
SELECT e.cache_key, payload, created_at_unix_secs, last_success_unix_secs, hit_count + coalesce(n, 0) AS hit_count,
  greatest(expires_at_unix_secs, coalesce(t + 604800, 0)) AS expires_at_unix_secs
FROM entries e LEFT JOIN (
  SELECT query_hash AS cache_key, count(*) AS n, max(observed_at_unix_secs) AS t FROM logs
  WHERE status_code = 200 AND NOT stale AND cache_hit GROUP BY 1) h USING (cache_key)""",
    "cache_residency": _with(LOGS, _lifetimes(3_600)) + "SELECT * FROM lifetimes",
    "cache_residency_7d": _with(LOGS, _lifetimes(604_800)) + "SELECT * FROM lifetimes",
    "resolve_requests": _with(LOGS, ENTRIES, REQUESTS, RESOLVED) + "SELECT * FROM answers",
    "envelopes": _with(LOGS, ENTRIES, REQUESTS, RESOLVED) + """
SELECT request_id, CASE WHEN error_code IS NULL THEN '{"data":' || CAST(to_json(data) AS VARCHAR) || ',"cached":' ||
  CAST(cached AS VARCHAR) || ',"stale":' || CAST(stale AS VARCHAR) || ',"source":"' || source || '"}' END AS envelope
FROM answers""",
    "error_bodies": _with(LOGS, ENTRIES, REQUESTS, RESOLVED) + """
, failed AS (
  SELECT request_id, error_code, error_message FROM answers
  UNION ALL SELECT id, 'bad_request',
    CASE rejected_for WHEN 'text' THEN field || ' is required' WHEN 'endpoint' THEN 'endpoint must use https'
      ELSE 'lang must be a valid BCP-47-style language tag' END FROM checked WHERE rejected_for IS NOT NULL)
SELECT request_id, CASE WHEN error_code IS NOT NULL THEN
  '{"error":{"code":"' || error_code || '","message":"' || error_message || '"}}' END AS body FROM failed""",
    "display_source": _with(LOGS, ENTRIES, REQUESTS, RESOLVED) + """
SELECT request_id, CASE WHEN error_code IS NOT NULL THEN 'error' WHEN stale THEN 'stale' ELSE source END
  AS display_source FROM answers""",
    "origin_classes": _with(LOGS, ENTRIES) + "SELECT cache_key, origin_class FROM classes",
    "outcome_status": _with(LOGS) + """
SELECT id, CAST([400, 502, 503, 503, 503, 200][k % 6 + 1] AS SMALLINT) AS status_code FROM logs""",
    "log_rows": _with(LOGS, ENTRIES, REQUESTS, RESOLVED) + """
SELECT id, observed_at_unix_secs, route, cache_key AS query_hash,
  coalesce(source IN ('cache', 'stale_cache'), false) AS cache_hit, coalesce(source = 'stale_cache', false) AS stale,
  latency_ms, sha256(client) AS client_hash,
  CAST(CASE WHEN source IS NOT NULL THEN 200 WHEN origin_class IS NULL THEN 503 ELSE 502 END AS SMALLINT) AS status_code,
  CASE WHEN route = 'entity' AND source IN ('cache', 'origin') THEN
    '{"entity_id":"' || resource || '","lang":"' || lang || '","endpoint":' ||
    CASE WHEN endpoint IS NULL THEN 'null' ELSE '"' || endpoint || '"' END || '}' ELSE '{}' END AS metadata
FROM resolved
UNION ALL SELECT id, observed_at_unix_secs, route, placeholder, false, false, latency_ms, sha256(client),
  CAST(400 AS SMALLINT), '{}' FROM checked WHERE rejected_for = 'text'""",
    "entity_hits": _with(LOGS, HITS) + "SELECT * FROM hits",
    "popular_entities": _with(LOGS, HITS) + """
SELECT * FROM hits ORDER BY hits DESC, entity_id, query_hash, lang, endpoint NULLS FIRST LIMIT 25""",
    "warm_candidates": _with(LOGS, HITS, ENTRIES) + """
SELECT h.* FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM entries e, latest WHERE e.cache_key = h.query_hash AND e.last_success_unix_secs > as_of - 29 * 86400)""",
    "warm_cache": _with(LOGS, HITS, ENTRIES, TRIPLES, LOOKUP, WARM) + """
SELECT p.query_hash AS cache_key, payload, as_of AS created_at_unix_secs, as_of AS last_success_unix_secs,
  CAST(0 AS BIGINT) AS hit_count, as_of + 604800 AS expires_at_unix_secs FROM payloads p, latest
UNION ALL SELECT * FROM entries WHERE cache_key NOT IN (SELECT query_hash FROM payloads)""",
    "warm_result": _with(LOGS, HITS, TRIPLES, LOOKUP, WARM) + """
SELECT (SELECT count(*) FROM payloads) AS refreshed,
  (SELECT count(*) FROM popular) - (SELECT count(*) FROM payloads) AS failed""",
    "entity_lookup": _with(LOGS, TRIPLES, LOOKUP) + """
SELECT subject, lang, label, abstract, property, value FROM found WHERE place <= 50""",
    "entity_lookup_limited": _with(LOGS, TRIPLES, LOOKUP) + """
SELECT subject, lang, label, abstract, property, value FROM found WHERE place <= 3""",
    "label_search": _with(TRIPLES, SEARCH) + """
SELECT query_id, entity, label, abstract FROM matched WHERE place <= 10""",
    "label_search_clamped": _with(TRIPLES, SEARCH) + """
SELECT query_id, entity, label, abstract FROM matched WHERE place <= CASE WHEN item_id < 0 THEN 50 ELSE 1 END""",
    "triple_pattern": _with(TRIPLES) + f"SELECT * FROM triples ORDER BY {TRIPLE_ORDER} LIMIT 5",
    "triple_pattern_bound": _with(TRIPLES) + """
SELECT * FROM triples WHERE predicate = 'http://dbpedia.org/ontology/knownFor'
  AND object = 'http://dbpedia.org/resource/src1'""",
    "origin_incidents": _with(LOGS, CALLS) + """
SELECT endpoint, min(ts) AS started_at_unix_secs, max(ts) AS ended_at_unix_secs, count(*) AS failures
FROM runs WHERE NOT ok GROUP BY endpoint, run HAVING count(*) >= 3""",
    "breaker_transitions": _transitions(3, 30),
    "breaker_transitions_slow": _transitions(2, 3_600),
    "breaker_snapshot": _with(LOGS, CALLS) + """
, ended AS (
  SELECT endpoint, arg_max(CASE WHEN ok THEN 0 ELSE nth END, (ts, seq)) AS failure_count, max(ts) AS last_ts,
    max(ts) FILTER (ok) AS last_success_unix_secs FROM counted GROUP BY endpoint)
SELECT endpoint, CASE WHEN failure_count < 1 THEN 'closed' WHEN as_of - last_ts >= 30 THEN 'half_open' ELSE 'open' END
  AS state, failure_count, CASE WHEN failure_count >= 1 THEN last_ts END AS opened_at_unix_secs, last_success_unix_secs
FROM ended, latest""",
    "rate_breaches": _with(LOGS) + """
, seconds AS (
  SELECT client_hash, observed_at_unix_secs, count(*) AS requests FROM logs GROUP BY ALL)
SELECT * FROM (
  SELECT *, CAST(sum(requests) OVER (PARTITION BY client_hash ORDER BY observed_at_unix_secs
    RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_requests FROM seconds)
WHERE window_requests > 8""",
    "stream_ingest": _with(LOGS) + f"SELECT {LOG_COLUMNS} FROM logs",
    "log_two_writers": _with(LOGS) + f"SELECT {LOG_COLUMNS} FROM logs",
    "stream_timeseries": _with(LOGS, POINTS) + "SELECT * FROM points",
    "stream_rolling": _with(LOGS) + f"""
, ends AS (
  SELECT unnest(range(min(observed_at_unix_secs) // 3600 * 3600 + 3600,
    max(observed_at_unix_secs) // 3600 * 3600 + 86400 + 1, 3600)) AS e
  FROM logs)
SELECT e AS window_end_unix_secs, {COUNTS}, {RATES}, {_rate(FAILED)} AS origin_error_rate, {P95}
FROM ends JOIN logs ON observed_at_unix_secs >= e - 86400 AND observed_at_unix_secs < e GROUP BY e""",
    "stream_residency": _with(LOGS, _lifetimes(3_600)) + "SELECT * FROM lifetimes",
    "stream_breaker": _transitions(3, 30),
    "stream_warm": _with(LOGS, HITS, ENTRIES, TRIPLES, LOOKUP) + """
, cut AS (SELECT (min(observed_at_unix_secs) + 3 * max(observed_at_unix_secs)) // 4 AS c FROM logs),
early AS (SELECT logs.* FROM logs, cut WHERE observed_at_unix_secs <= c),
ticks AS (SELECT (SELECT max(observed_at_unix_secs) FROM early) AS a1, (SELECT as_of FROM latest) AS a2),
pay AS (
  SELECT subject, lang, coalesce('[' || string_agg(
    '{"label":' || coalesce(CAST(to_json(label) AS VARCHAR), 'null')
    || ',"abstract":' || coalesce(CAST(to_json(abstract) AS VARCHAR), 'null')
    || ',"property":' || coalesce(CAST(to_json(property) AS VARCHAR), 'null')
    || ',"value":' || coalesce(CAST(to_json(value) AS VARCHAR), 'null') || '}', ',' ORDER BY place)
    FILTER (label IS NOT NULL OR abstract IS NOT NULL OR property IS NOT NULL) || ']', '[]') AS payload
  FROM found WHERE place <= 50 GROUP BY subject, lang),
hits1 AS (
  SELECT json_extract_string(metadata, '$.entity_id') AS entity_id, query_hash,
    coalesce(json_extract_string(metadata, '$.lang'), 'en') AS lang,
    json_extract_string(metadata, '$.endpoint') AS endpoint, count(*) AS hits
  FROM early WHERE route = 'entity' AND metadata LIKE '%"entity_id"%' GROUP BY ALL),
top1 AS (SELECT * FROM hits1 ORDER BY hits DESC, entity_id, query_hash, lang, endpoint NULLS FIRST LIMIT 25),
top2 AS (SELECT * FROM hits ORDER BY hits DESC, entity_id, query_hash, lang, endpoint NULLS FIRST LIMIT 25),
warm1 AS (
  SELECT query_hash AS cache_key, payload FROM top1 t JOIN pay p ON p.lang = t.lang AND p.subject = 'http://' ||
    CASE WHEN t.lang = 'am' THEN 'am.' ELSE '' END || 'dbpedia.org/resource/' || entity_id
  WHERE query_hash NOT IN (SELECT cache_key FROM entries, ticks WHERE last_success_unix_secs > a1 - 864000)),
after1 AS (
  SELECT cache_key, payload, a1 AS created_at_unix_secs, a1 AS last_success_unix_secs, CAST(0 AS BIGINT) AS hit_count,
    a1 + 604800 AS expires_at_unix_secs FROM warm1, ticks
  UNION ALL SELECT * FROM entries WHERE cache_key NOT IN (SELECT cache_key FROM warm1)),
warm2 AS (
  SELECT query_hash AS cache_key, payload FROM top2 t JOIN pay p ON p.lang = t.lang AND p.subject = 'http://' ||
    CASE WHEN t.lang = 'am' THEN 'am.' ELSE '' END || 'dbpedia.org/resource/' || entity_id
  WHERE query_hash NOT IN (SELECT cache_key FROM after1, ticks WHERE last_success_unix_secs > a2 - 864000))
SELECT cache_key, payload, a2 AS created_at_unix_secs, a2 AS last_success_unix_secs, CAST(0 AS BIGINT) AS hit_count,
  a2 + 604800 AS expires_at_unix_secs FROM warm2, ticks
UNION ALL SELECT * FROM after1 WHERE cache_key NOT IN (SELECT cache_key FROM warm2)""",
}
ORACLES["stored_entity_lookup"] = ORACLES["entity_lookup"]
ORACLES["stored_label_search"] = ORACLES["label_search"]
ORACLES["stored_triple_pattern"] = ORACLES["triple_pattern_bound"]
ORACLES["log_roundtrip"] = ORACLES["scan_request_logs"]
ORACLES["stored_cache_upsert"] = ORACLES["cache_upsert"]
ORACLES["stored_fresh_view"] = ORACLES["cache_fresh_view"]
ORACLES["typed_key_exists"] = ORACLES["json_key_exists"]
ORACLES["typed_metadata_fields"] = ORACLES["metadata_fields"]
ORACLES["typed_entity_hits"] = ORACLES["entity_hits"]
