"""Small helpers over VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(*keys: str) -> str:
    """Variant path of nested keys; every key is quoted, so dots inside a key are literal."""
    parts = []
    for key in keys:
        quote = '"' if '"' not in key else "'"
        if quote in key:
            raise ValueError(f"key {key!r} holds both kinds of quotes")
        parts.append(f"[{quote}{key}{quote}]")
    return "$" + "".join(parts)


def get(value: Column, *keys: str, to: str = "variant") -> Column:
    """Member at a path, SQL NULL when absent. JSON null stays a variant null for to='variant'."""
    return F.try_variant_get(value, json_path(*keys), to)


def kind(value: Column) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, OBJECT<..> or ARRAY<..>; NULL for absent."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def strict_string(value: Column) -> Column:
    """The text of a JSON string; NULL for every other kind."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def json_or_text(text: Column) -> Column:
    """Parse as JSON, else keep the text itself as a JSON string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def variant_of(value: Column) -> Column:
    return value.cast("variant")


def wire_value(wire: Column, members: dict[str, str]) -> Column:
    """Variant of a one-of struct of wire kinds.

    `members` names the member of `wire` per kind: raw_bytes (binary, invalid UTF-8 replaced),
    boolean, integer, float (NaN and infinities become null), timestamp (text), map
    (map<string,variant>), array (array<variant>). The first set member wins; none gives JSON null.
    """
    convert = {
        "raw_bytes": lambda c: variant_of(F.make_valid_utf8(c.cast("string"))),
        "boolean": variant_of,
        "integer": variant_of,
        "float": lambda c: F.when(
            ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), variant_of(c)
        ),
        "timestamp": lambda c: variant_of(
            F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        ),
        "map": F.to_variant_object,
        "array": F.to_variant_object,
    }
    unknown = set(members) - set(convert)
    if unknown:
        raise ValueError(f"unknown wire kinds {sorted(unknown)}")
    options = [convert[name](wire[column]) for name, column in members.items()]
    return F.coalesce(*options, F.parse_json(F.lit("null")))


def wire_of(value: Column) -> Column:
    """The one-of struct of a JSON value, inverse to `wire_value`.

    Text becomes bytes; integers of 64 bits stay integers, other numbers become floats; objects and
    arrays keep their members as VARIANT, to be converted in turn where a consumer opens them.
    """
    k = kind(value)
    number = k.isin("DOUBLE", "FLOAT") | k.startswith("DECIMAL")

    def read(to: str) -> Column:
        return F.try_variant_get(value, "$", to)

    return F.struct(
        F.when(k == "STRING", read("string").cast("binary")).alias("raw_bytes"),
        F.when(k == "BOOLEAN", read("boolean")).alias("boolean"),
        F.when(k == "BIGINT", read("bigint")).alias("integer"),
        F.when(number, read("double")).alias("float"),
        read("map<string,variant>").alias("map"),
        read("array<variant>").alias("array"),
    )


# Timestamps hold microseconds in 64 bits.
MAX_MILLIS = 9_223_372_036_854_775


def epoch_time(value: Column, kind_of_value: Column) -> Column:
    """Timestamp of epoch milliseconds, as a JSON integer or as digits; NULL for anything else.

    Total on any event: integers beyond the range of timestamps give NULL.
    """
    digits = F.regexp_extract(F.try_variant_get(value, "$", "string"), "^[+-]?[0-9]+$", 0)
    millis = F.when(kind_of_value == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(
        kind_of_value == "STRING", digits.try_cast("bigint")
    )
    return F.timestamp_millis(F.when(millis.between(-MAX_MILLIS, MAX_MILLIS), millis))
