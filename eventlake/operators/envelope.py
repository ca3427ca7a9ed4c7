"""Landed records to events (event_id STRING, data VARIANT, metadata MAP<STRING,VARIANT>) and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.variants import get, is_object, json_or_text, strict_string, variant_of

UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
EMPTY_METADATA = "cast(map() as map<string,variant>)"


def _dashed(hexes: Column) -> Column:
    """8-4-4-4-12 text of the first 32 hex digits."""
    return F.regexp_replace(
        hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"
    )


def uuid_text(id_bytes: Column) -> Column:
    """UUID text of a 16-byte binary; NULL for any other length."""
    return F.when(F.octet_length(id_bytes) == 16, _dashed(F.lower(F.hex(id_bytes))))


def derived_id(*parts: Column) -> Column:
    """Repeatable id of a record: a retry or replay of the same input gives the same id.

    Callers pass what locates the record (file, topic/partition/offset) and its content.
    """
    text = F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return _dashed(F.sha2(text, 256))


def with_entries(metadata: Column, *, drop: tuple[str, ...] = (), **entries: Column) -> Column:
    """Set map entries; an entry whose new value is NULL stays as it was. `drop` removes entries."""
    none = F.expr(EMPTY_METADATA)
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(*drop, *entries))
    fresh = []
    for name, value in entries.items():
        final = F.coalesce(value, F.try_element_at(metadata, F.lit(name)))
        fresh.append(F.when(final.isNotNull(), F.create_map(F.lit(name), final)).otherwise(none))
    return F.map_concat(kept, *fresh)


def unwrap_payload(value: Column, fields: Column) -> Column:
    """Payload of a log record: `value` if set (JSON text is parsed, other text kept), else `fields`."""
    present = value.isNotNull() & ~F.is_variant_null(value)
    text = strict_string(value)
    return (
        F.when(present & text.isNotNull(), json_or_text(text))
        .when(present, value)
        .otherwise(F.coalesce(fields, F.parse_json(F.lit("{}"))))
    )


COLLECTOR = "vector"  # fixed value: the entry of the collecting agent


def ingest_stamp(metadata: Column) -> Column:
    """The collector's ingest time, when that is a string."""
    return strict_string(
        get(F.try_element_at(metadata, F.lit(COLLECTOR)), "ingest_timestamp")
    )


def lift_ingest_time(metadata: Column) -> Column:
    """Drop the collector's own entry; keep its ingest time as `timestamp`."""
    stamp = variant_of(ingest_stamp(metadata))
    return with_entries(metadata, drop=(COLLECTOR,), timestamp=stamp)


def with_correlation(metadata: Column, event_id: Column) -> Column:
    """Default `correlation_uid` to the event id."""
    return F.when(F.map_contains_key(metadata, "correlation_uid"), metadata).otherwise(
        F.map_concat(metadata, F.create_map(F.lit("correlation_uid"), variant_of(event_id)))
    )


def push_events(landed: DataFrame, text: str = "value", position: tuple[str, ...] = ()) -> DataFrame:
    """Pushed records, one JSON text each, to events.

    A record is ``{"log": {"value", "fields", "metadata_full"}}``; ``metadata_full`` holds ``value``
    (an object), ``source_type``, ``source_id`` and ``source_event_id`` (base64 of 16 bytes).
    Metric, trace, empty and malformed records get a `reject_reason`; `raw` and the `position`
    columns are kept.
    """
    # One projection per step: what several members read is computed once.
    wrapped = landed.select(*position, F.col(text).alias("raw"), F.try_parse_json(text).alias("w"))
    logs = wrapped.select("*", get(F.col("w"), "log").alias("log")).withColumn(
        "meta", get(F.col("log"), "metadata_full")
    )
    reason = (
        F.when(F.col("w").isNull(), "malformed record")
        .when(is_object(F.col("log")), F.lit(None).cast("string"))
        .when(get(F.col("w"), "metric").isNotNull(), "metric record")
        .when(get(F.col("w"), "trace").isNotNull(), "trace record")
        .otherwise("empty record")
    )
    meta = F.col("meta")
    given = uuid_text(
        F.try_to_binary(strict_string(get(meta, "source_event_id")), F.lit("base64"))
    )
    located = derived_id(*[F.col(p) for p in position], F.col("raw"))
    members = logs.select(
        *position,
        "raw",
        reason.alias("reject_reason"),
        F.coalesce(given, located).alias("event_id"),
        get(F.col("log"), "value").alias("value"),
        get(F.col("log"), "fields").alias("fields"),
        F.coalesce(
            F.try_variant_get(get(meta, "value"), "$", "map<string,variant>"), F.expr(EMPTY_METADATA)
        ).alias("metadata"),
        variant_of(strict_string(get(meta, "source_type"))).alias("source_type"),
        variant_of(strict_string(get(meta, "source_id"))).alias("source_id"),
    )
    own = F.col("metadata")
    stamped = members.withColumns(
        {
            "stamp": variant_of(ingest_stamp(own)),
            "correlation": F.coalesce(
                F.try_element_at(own, F.lit("correlation_uid")), variant_of(F.col("event_id"))
            ),
        }
    )
    metadata = with_entries(
        own,
        drop=(COLLECTOR,),
        source_type=F.col("source_type"),
        source_id=F.col("source_id"),
        timestamp=F.col("stamp"),
        correlation_uid=F.col("correlation"),
    )
    return stamped.select(
        *position,
        "raw",
        "reject_reason",
        "event_id",
        unwrap_payload(F.col("value"), F.col("fields")).alias("data"),
        metadata.alias("metadata"),
    )


def accepted(df: DataFrame) -> DataFrame:
    """Events without a reject reason (not a filter: that would be pushed down and parse twice)."""
    return df.selectExpr(
        "inline(CASE WHEN reject_reason IS NULL THEN "
        "array(named_struct('event_id', event_id, 'data', data, 'metadata', metadata)) END)"
    )


def from_json_values(df: DataFrame, data: Column, metadata: Column | None = None, *, ids: list[Column]) -> DataFrame:
    """Events of bare JSON values, with given or empty metadata; `ids` locate a record."""
    meta = F.expr(EMPTY_METADATA) if metadata is None else F.coalesce(metadata, F.expr(EMPTY_METADATA))
    return df.select(derived_id(*ids).alias("event_id"), data.alias("data"), meta.alias("metadata"))


def to_output_record(events: DataFrame, restore_source: bool = False) -> DataFrame:
    """Outgoing record text of each event: fields (non-objects give {}), id and metadata.

    With `restore_source`, source_type and source_id leave the metadata map for their own members,
    the correlation default is applied, and the ingest time goes back below the collector's entry
    when there is one.
    """
    data, event_id = F.col("data"), F.col("event_id")
    fields = F.when(is_object(data), data).otherwise(F.parse_json(F.lit("{}")))
    members = [event_id.alias("source_event_id")]
    if restore_source:
        meta = F.col("metadata")
        events = events.withColumn("metadata", with_correlation(meta, event_id))
        collector = F.try_variant_get(
            F.try_element_at(meta, F.lit(COLLECTOR)), "$", "map<string,variant>"
        )
        stamp = strict_string(F.try_element_at(meta, F.lit("timestamp")))
        events = events.withColumns({"__collector": collector, "__stamp": stamp})
        stamped = F.when(
            F.col("__collector").isNotNull() & F.col("__stamp").isNotNull(),
            F.to_variant_object(
                with_entries(F.col("__collector"), ingest_timestamp=variant_of(F.col("__stamp")))
            ),
        )
        events = events.withColumn("metadata", with_entries(meta, **{COLLECTOR: stamped}))
        own = ("source_type", "source_id")
        members += [strict_string(F.try_element_at(meta, F.lit(k))).alias(k) for k in own]
        members.append(F.map_filter(meta, lambda k, _: ~k.isin(*own)).alias("value"))
    else:
        members.append(F.col("metadata").alias("value"))
    record = F.struct(fields.alias("fields"), F.struct(*members).alias("metadata_full"))
    return events.select("event_id", F.to_json(record).alias("record"))


def to_matcher_event(events: DataFrame) -> DataFrame:
    """Add the logsource struct the matcher filters on."""
    return events.withColumn("logsource", logsource_of(F.col("metadata")))


def from_matcher_event(matched: DataFrame) -> DataFrame:
    """Back to an event: the id is `metadata.id` when a UUID, else the given id; metadata is emptied."""
    own = strict_string(F.try_element_at(F.col("metadata"), F.lit("id")))
    return matched.select(
        F.when(own.rlike(UUID_PATTERN), F.lower(own)).otherwise(F.col("event_id")).alias("event_id"),
        "data",
        F.expr(EMPTY_METADATA).alias("metadata"),
    )


def logsource_of(metadata: Column) -> Column:
    """logsource{product, service, category} of an event, empty members as NULL.

    Read from `metadata.logsource`, else from the tag at `metadata.sigma.logsource`.
    """
    tag = F.coalesce(
        F.try_element_at(metadata, F.lit("logsource")),
        get(F.try_element_at(metadata, F.lit("sigma")), "logsource"),
    )
    return F.struct(
        *[strict_string(get(tag, part)).alias(part) for part in ("product", "service", "category")]
    )


