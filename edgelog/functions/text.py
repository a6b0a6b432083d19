"""Whitespace handling by the Unicode White_Space property, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_ws(text: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space and strip both ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also map non-ASCII letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
