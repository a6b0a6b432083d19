"""Makers of odd documents."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "key1 string, nodes int, spans string, start string, n_words string, score string, target string, rep string, "
    "bucket string, ids string, value string, piece string, fingerprint string, prefixes string, _extra int"
)


def text_of(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(n))


def documents(spark, rows: list[tuple]):
    """Rows (doc_id, text) as documents with columns named like what the operators make."""
    filler = ["clash", 1, *["clash"] * 12, 2]
    wide = [(i, t, "en", "src", len(t) if t is not None else None, *filler) for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)
