"""The operators' registered queries, each over the whole of its tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.llm import (
    alignment,
    chat_format,
    collocations,
    decontamination,
    jaccard_join,
    packing,
    piecewise_hash,
    quality,
    secret_scan,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
)
from edgelog.llm.shared import prepare_workers
from edgelog.session import new_shared_path


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(_read(spark, sf, "documents"), digest=True)
    return removed.withColumnRenamed("kept", "kept_sha256")


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf, "documents"))


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "token_files")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(_read(spark, sf, "documents"), path, vocabulary, end_id=0)
    return token_files.read_token_files(spark, path)


def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    scanner = secret_scan.fit(secret_scan.label_findings(docs))
    return secret_scan.scan(docs, scanner)


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_read(spark, sf, "documents"), vocabulary, end_id=1, keep_ids=False)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    held_out = F.expr("crc32(CAST(doc_id AS string)) % 5 = 0")
    model = toxicity.fit(docs, _read(spark, sf, "labels").where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "passages",
    )


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.find_contamination(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))
    return decontamination.report(found)


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = _read(spark, sf, "conversations").selectExpr("conv_id", "CAST(turn AS bigint) AS turn", "role", "text")
    return chat_format.report(chat_format.format_chats(turns.unionByName(extra)))


def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return piecewise_hash.report(piecewise_hash.edited_neighbours(_read(spark, sf, "documents")))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    model = quality.fit(docs, _read(spark, sf, "labels"))
    return quality.score(docs, model).withColumn("keep", F.col("score") >= 0.5)


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.align_documents(_read(spark, sf, "documents"), *paths, digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf, "documents"))


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_jaccard_join,
        op3_token_files,
        op4_secret_scan,
        op5_packing,
        op6_toxicity,
        op7_decontamination,
        op8_chat_format,
        op9_fingerprints,
        op10_quality,
        op11_alignment,
        op12_collocations,
        op13_token_counts,
    )
}

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
        x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM s),
        y AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS again FROM x),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM y WHERE again),
        q AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
        k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN q USING (doc_id)),
        v AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        t AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS kept
              FROM v LEFT JOIN r ON v.doc_id = r.doc_id AND v.i = r.i WHERE r.i IS NULL GROUP BY v.doc_id)
        SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM k LEFT JOIN t USING (doc_id)""",
    "op2_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
        p AS (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i
              FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
              FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b, shared = na.n AND shared = nb.n AS equal
              FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
              WHERE 10 * shared >= 8 * (na.n + nb.n - shared)),
        r AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.r),
        m AS (SELECT doc_id, min(r) AS class_id FROM r GROUP BY doc_id),
        l AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (equal) AS copy FROM e GROUP BY a)
        SELECT doc_id, class_id, least(doc_id, coalesce(copy, doc_id)) AS copy_of, coalesce(n_links, 0) AS n_links
        FROM m LEFT JOIN l USING (doc_id)""",
    "op7_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_WORDS}) AS w
              FROM benchmark),
        p AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
              FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM p),
        s AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g)),
        h AS (SELECT doc_id, i, s.k, item
              FROM s JOIN g ON g.k = s.k AND g.g = array_to_string(list_slice(w, i, i + s.k - 1), ' ')),
        n AS (SELECT doc_id, count(DISTINCT i) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>') AS safe,
                     role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens
              FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(length(safe) + 7 + CASE WHEN opens THEN length(role) + 6 ELSE 0 END) AS BIGINT)
                   AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op12_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, count(*) AS f
              FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k))
              GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, k AS size, g, f AS a, string_split(g, ' ') AS x, unnest(range(1, k)) AS k FROM f WHERE k > 1),
        t AS (SELECT c.lang, size, c.g, a, c.k, l.f AS l, r.f AS r, n,
                     CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
              FROM c JOIN s USING (lang)
              JOIN f l ON l.lang = c.lang AND l.k = c.k AND l.g = array_to_string(list_slice(x, 1, c.k), ' ')
              JOIN f r ON r.lang = c.lang AND r.k = size - c.k AND r.g = array_to_string(list_slice(x, c.k + 1, size), ' ')),
        b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (SELECT lang, g, max(f) AS within
              FROM (SELECT lang, f, unnest([array_to_string(string_split(g, ' ')[:k - 1], ' '),
                                            array_to_string(string_split(g, ' ')[2:], ' ')]) AS g FROM f WHERE k > 2)
              GROUP BY ALL),
        o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
              FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE coalesce(within, 0) < a)
        SELECT lang, rank, g AS phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
}
