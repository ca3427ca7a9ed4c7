"""Per-source projections: unnest, tag, remap, choose the body rules are matched on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.variants import get, strict_string, variant_of
from eventlake.operators.envelope import derived_id, with_entries


def unnest_records(events: DataFrame, key: str = "Records") -> DataFrame:
    """One event per element of the array at `key`; the element's position enters its id."""
    items = F.try_variant_get(get(F.col("data"), key), "$", "array<variant>")
    return (
        events.select("event_id", "metadata", F.posexplode(items).alias("pos", "data"))
        .withColumn("event_id", derived_id(F.col("event_id"), F.col("pos")))
        .select("event_id", "data", "metadata")
    )


def tag_logsource(
    events: DataFrame,
    product: str | None = None,
    service: str | None = None,
    vendor: str | None = None,
) -> DataFrame:
    """Write the log taxonomy to `metadata.sigma`; only the given parts become members."""
    given = {"vendor": vendor, "product": product, "service": service}
    parts = [F.lit(value).alias(name) for name, value in given.items() if value is not None]
    if not parts:
        return events
    tag = F.to_variant_object(F.struct(F.struct(*parts).alias("logsource")))
    return events.withColumn("metadata", with_entries(F.col("metadata"), sigma=tag))


def tag_source(events: DataFrame, source_type: str, source_id: Column | str) -> DataFrame:
    """Write `metadata.source_id` as source-<type>_<id>."""
    ident = F.lit(source_id) if isinstance(source_id, str) else source_id
    label = F.concat(F.lit(f"source-{source_type}_"), ident)
    return events.withColumn("metadata", with_entries(F.col("metadata"), source_id=variant_of(label)))


def nested_struct(mapping: dict[str, Column]) -> Column:
    """Struct from dotted target paths: {'user.name': col} gives {user: {name: col}}."""
    tree: dict = {}
    for path, column in mapping.items():
        *parents, leaf = path.split(".")
        node = tree
        for name in parents:
            node = node.setdefault(name, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path!r} runs through a mapped value")
        if leaf in node:
            raise ValueError(f"{path!r} is mapped twice")
        node[leaf] = column

    def build(node: dict) -> Column:
        return F.struct(
            *[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]
        )

    return build(tree)


def remap(events: DataFrame, mapping: dict[str, Column], keep_raw: bool = True) -> DataFrame:
    """Rename and convert into the shared schema; columns of `mapping` read from `data`.

    The original body is kept as JSON text in `raw_data` and the event is marked `metadata.ocsf`,
    so that rules written for the vendor's format still see it.
    """
    full = dict(mapping)
    if keep_raw:
        full["raw_data"] = F.to_json(F.col("data"))
    body = F.to_variant_object(nested_struct(full))
    return events.select(
        "event_id",
        body.alias("data"),
        with_entries(F.col("metadata"), ocsf=variant_of(F.lit(True))).alias("metadata"),
    )


def detection_body(data: Column, metadata: Column) -> Column:
    """What rules are matched on: the parsed `raw_data` of a remapped event, else the data itself."""
    raw = F.try_parse_json(strict_string(get(data, "raw_data")))
    return F.when(F.map_contains_key(metadata, "ocsf"), F.coalesce(raw, data)).otherwise(data)
