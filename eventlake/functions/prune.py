"""JSON text of a row without nulls, empty objects and empty arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pruned(value: Column, dtype: T.DataType, in_array: bool = False) -> Column:
    """Turn members that would print as null, {} or [] into NULL, bottom-up along the schema.

    Array elements are never dropped: an emptied object inside an array stays an empty object.
    """
    if isinstance(dtype, T.StructType):
        kept = [
            pruned(value[field.name], field.dataType).alias(field.name) for field in dtype.fields
        ]
        if not kept:
            return value if in_array else F.lit(None).cast(dtype)
        body = F.struct(*kept)
        if in_array:
            return F.when(value.isNotNull(), body)
        some = reduce(
            lambda a, b: a | b, [pruned(value[f.name], f.dataType).isNotNull() for f in dtype.fields]
        )
        return F.when(value.isNotNull() & some, body)
    if isinstance(dtype, T.ArrayType):
        items = value
        if isinstance(dtype.elementType, (T.StructType, T.ArrayType, T.MapType)):
            items = F.transform(value, lambda x: pruned(x, dtype.elementType, in_array=True))
        return items if in_array else F.when(F.size(value) > 0, items)
    if isinstance(dtype, T.MapType):
        values = F.transform_values(value, lambda _, v: pruned(v, dtype.valueType))
        kept_map = F.map_filter(values, lambda _, v: v.isNotNull())
        return kept_map if in_array else F.when(F.size(kept_map) > 0, kept_map)
    return value


def prune_json(row: Column, schema: T.StructType) -> Column:
    """Pruned JSON object text of a struct column; an emptied row gives {}."""
    return F.coalesce(
        F.to_json(pruned(row, schema, in_array=True), {"ignoreNullFields": "true"}), F.lit("{}")
    )
