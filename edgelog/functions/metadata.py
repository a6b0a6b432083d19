"""Access to the JSON kept in a log row's ``metadata``."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(metadata: Column, key: str) -> Column:
    """True if the object has the key, even with a JSON null as its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))


def meta(metadata: Column, key: str) -> Column:
    """The value of a key as text; null if it is missing or a JSON null."""
    return F.get_json_object(metadata, f"$.{key}")


def typed(metadata: Column) -> Column:
    """JSON text as a VARIANT, to be parsed once where rows come in; null for text that is no JSON or repeats a member."""
    return F.try_parse_json(metadata)


def typed_has_key(metadata: Column, key: str) -> Column:
    """``has_key`` of a VARIANT."""
    return F.try_variant_get(metadata, f"$.{key}", "variant").isNotNull()


def typed_meta(metadata: Column, key: str) -> Column:
    """``meta`` of a VARIANT."""
    return F.try_variant_get(metadata, f"$.{key}", "string")


def is_json(text: Column) -> Column:
    """True for text that holds exactly one JSON value; members of an object may repeat.

    The parser ignores whatever follows the first value. Text that parses both as the element of
    an array and as the value of a member can only be one complete value. Numbers of any size and any depth that the
    parser takes count as JSON.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

    def parses(*parts) -> Column:
        return F.from_json(F.concat(*parts), "v string", strict)["v"].isNotNull()

    in_array = parses(F.lit('{"v":['), text, F.lit("]}"))
    in_object = parses(F.lit('{"v":{"w":'), text, F.lit("}}"))
    return in_array & in_object
