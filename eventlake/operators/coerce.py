"""Strict coercion of a VARIANT column to a declared schema, with a reject reason per row.

Nullable members of the wrong type become NULL. A row is rejected when a required member is
missing or unusable, and when an object or array is expected but something else is present
(an explicit JSON null included). Members that are not declared are dropped. A missing object
becomes an object of nulls; a missing array becomes NULL.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.variants import epoch_time, is_object, json_path, kind


class _Members:
    """Members of a VARIANT by path. In a table each is read once, into a column of its own."""

    def __init__(self, root: Column, in_table: bool):
        self.root = root
        self.in_table = in_table
        self.values: dict[str, Column] = {}
        self.kinds: dict[str, Column] = {}

    def at(self, path: tuple[str, ...]) -> tuple[Column, Column]:
        """(member, its kind); both NULL when absent."""
        value = F.try_variant_get(self.root, json_path(*path), "variant") if path else self.root
        if not self.in_table:
            return value, kind(value)
        name = json_path(*path)
        if name not in self.values:
            self.values[name] = value.alias(f"__v{len(self.values)}")
            self.kinds[name] = kind(F.col(f"__v{len(self.kinds)}")).alias(f"__k{len(self.kinds)}")
        index = list(self.values).index(name)
        return F.col(f"__v{index}"), F.col(f"__k{index}")


def _scalar(v: Column, k: Column, dtype: T.DataType) -> Column | None:
    """Value of a scalar type, NULL when the JSON kind does not fit; None for unsupported types."""

    def read(to: str) -> Column:
        return F.try_variant_get(v, "$", to)

    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return F.when(k == "BIGINT", read(dtype.simpleString()))
    if isinstance(dtype, T.DoubleType):
        number = k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
        return F.when(number, read("double"))
    if isinstance(dtype, T.BooleanType):
        return F.when(k == "BOOLEAN", read("boolean"))
    if isinstance(dtype, T.StringType):
        none = F.lit(None).cast("string")
        return F.when(k == "STRING", read("string")).when(k == "VOID", none).otherwise(F.to_json(v))
    if isinstance(dtype, T.TimestampType):
        return epoch_time(v, k)
    return None


def _member(
    members: _Members, path: tuple[str, ...], dtype: T.DataType, nullable: bool, label: str
) -> tuple[Column, Column | None]:
    """(value, reject reason or None when the member can never reject)."""
    v, k = members.at(path)
    missing = None if nullable else F.when(v.isNull(), F.lit(f"missing required field '{label}'"))

    if isinstance(dtype, T.StructType):
        values, reasons = [], []
        for field in dtype.fields:
            value, reason = _member(
                members, (*path, field.name), field.dataType, field.nullable, f"{label}.{field.name}"
            )
            values.append(value.alias(field.name))
            reasons.append(reason)
        wrong = F.when(~k.startswith("OBJECT"), F.lit(f"expected object for '{label}'"))
        return F.struct(*values), _first(missing, wrong, *reasons)

    if isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(v, "$", "array<variant>")

        def element(x: Column) -> tuple[Column, Column | None]:
            return _member(_Members(x, False), (), dtype.elementType, dtype.containsNull, label + "[]")

        value = F.transform(items, lambda x: element(x)[0])
        wrong = F.when(~k.startswith("ARRAY"), F.lit(f"expected array for '{label}'"))
        bad = None
        if element(F.lit(None).cast("variant"))[1] is not None:
            bad = F.when(
                F.exists(items, lambda x: element(x)[1].isNotNull()),
                F.lit(f"unusable element of '{label}'"),
            )
        return value, _first(missing, wrong, bad)

    value = _scalar(v, k, dtype)
    if value is None:
        unsupported = F.when(v.isNotNull(), F.lit(f"type not supported for '{label}'"))
        return F.lit(None).cast(dtype), _first(missing, unsupported)
    if nullable:
        return value, None
    return value, _first(missing, F.when(value.isNull(), F.lit(f"unusable value for '{label}'")))


def _first(*reasons: Column | None) -> Column | None:
    known = [r for r in reasons if r is not None]
    if not known:
        return None
    return known[0] if len(known) == 1 else F.coalesce(*known)


@lru_cache(maxsize=256)
def _projections(schema_json: str, data: str) -> tuple[list[Column], list[Column], Column, Column]:
    """Columns of the three projections. Building them takes longer than planning, so they are kept."""
    root = F.col(data)
    members = _Members(root, True)
    values, reasons = [], []
    for field in T.StructType.fromJson(json.loads(schema_json)).fields:
        value, reason = _member(members, (field.name,), field.dataType, field.nullable, field.name)
        values.append(value.alias(field.name))
        reasons.append(reason)
    top = F.when(root.isNull() | ~is_object(root), F.lit("expected object at top level"))
    reason = _first(top, *reasons)
    return list(members.values.values()), list(members.kinds.values()), F.struct(*values), reason


def coerce(df: DataFrame, schema: T.StructType, data: str = "data") -> DataFrame:
    """Add `row` (the coerced struct, partial for rejected rows) and `reject_reason` (NULL if accepted).

    Three projections: members, their kinds, values. Each member is looked up once per row.
    """
    members, kinds, row, reason = _projections(schema.json(), data)
    return (
        df.select("*", *members)
        .select("*", *kinds)
        .select(*df.columns, row.alias("row"), reason.alias("reject_reason"))
    )


def accepted_rows(coerced: DataFrame) -> DataFrame:
    """The schema's columns of accepted rows.

    Not a filter: Spark would push that below the projections and compute every member twice.
    """
    return coerced.selectExpr("inline(CASE WHEN reject_reason IS NULL THEN array(row) END)")
