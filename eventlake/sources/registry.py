"""Source types: log taxonomy, pre-step and mapping to the shared schema, open to the user."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.variants import get
from eventlake.operators.normalise import remap, tag_logsource, tag_source, unnest_records


@dataclass(frozen=True)
class SourceType:
    name: str
    product: str | None = None
    service: str | None = None
    vendor: str | None = None
    pre: Callable[[DataFrame], DataFrame] | None = None
    mapping: Callable[[], dict[str, Column]] | None = None


_TYPES: dict[str, SourceType] = {}


def register_source(source: SourceType) -> SourceType:
    _TYPES[source.name] = source
    return source


def source_type(name: str) -> SourceType:
    if name not in _TYPES:
        raise KeyError(f"unsupported source type {name!r}")
    return _TYPES[name]


def normalise(events: DataFrame, type_name: str, source_id: Column | str) -> DataFrame:
    """Chain of one source: pre-step, taxonomy tag, source tag, mapping."""
    source = source_type(type_name)
    if source.pre:
        events = events.transform(source.pre)
    events = tag_logsource(events, source.product, source.service, source.vendor)
    events = tag_source(events, source.name, source_id)
    return remap(events, source.mapping()) if source.mapping else events


def merge_sources(*parts: DataFrame) -> DataFrame:
    """All normalised sources as one set of events."""
    return reduce(lambda a, b: a.unionByName(b), parts)


# A registry is small by nature, but nothing enforces it: beyond this many rows no broadcast hint.
MAX_BROADCAST_ROWS = 100_000


def enrich_with_sources(events: DataFrame, sources: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Add type and name of the registered source; unknown sources give NULL."""
    dim = sources.select(
        F.col("id").alias(source_id),
        F.col("type").alias("source_type"),
        F.get_json_object("config", "$.name").alias("source_name"),
    )
    if dim.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        dim = F.broadcast(dim)
    return events.join(dim, source_id, "left")


def check_source_types(sources: DataFrame) -> DataFrame:
    """Registered sources whose type nobody registered."""
    return sources.where(~F.col("type").isin(*_TYPES) | F.col("type").isNull())


def _at(*keys: str, to: str = "string") -> Column:
    return get(F.col("data"), *keys, to=to)


def _iso_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


register_source(
    SourceType(
        "aws_cloudtrail",
        product="aws",
        service="cloudtrail",
        pre=unnest_records,
        mapping=lambda: {
            "class_uid": F.lit(6003),
            "time": _iso_millis(_at("eventTime")),
            "activity_name": _at("eventName"),
            "api.operation": _at("eventName"),
            "api.service.name": _at("eventSource"),
            "actor.app_name": _at("userAgent"),
            "user.uid": _at("userIdentity", "principalId"),
            "user.name": _at("userIdentity", "userName"),
            "user.type": _at("userIdentity", "type"),
            "src_endpoint.ip": _at("sourceIPAddress"),
            "metadata.uid": _at("eventID"),
            "status": F.when(_at("errorCode").isNull(), "Success").otherwise("Failure"),
        },
    )
)

register_source(
    SourceType(
        "okta",
        vendor="okta",
        product="audit",
        mapping=lambda: {
            "class_uid": F.lit(3002),
            "time": _iso_millis(_at("published")),
            "severity": _at("severity"),
            "activity_name": _at("eventType"),
            "message": _at("displayMessage"),
            "status": _at("outcome", "result"),
            "user.uid": _at("actor", "id"),
            "user.name": _at("actor", "alternateId"),
            "user.type": _at("actor", "type"),
            "src_endpoint.ip": _at("client", "ipAddress"),
            "metadata.uid": _at("uuid"),
        },
    )
)
