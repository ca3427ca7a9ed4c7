"""Alert lists, lookup, filters, facets and action payloads over the findings table."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.prune import prune_json
from eventlake.model import PARTITIONS

PAGE = 10  # rows of an alert list

# Severities from most to least urgent; all others rank last.
SEVERITY_RANKS = [("critical", 0), ("high", 1), ("medium", 2), ("low", 3), ("info", 4), ("informational", 4)]


def parse_time(text: str | None, default: datetime) -> datetime:
    """RFC 3339 time; missing or unparsable text gives the default."""
    try:
        parsed = datetime.fromisoformat(text) if text and len(text) > 10 else None
    except ValueError:
        parsed = None
    return default if parsed is None or parsed.tzinfo is None else parsed


def in_range(events: DataFrame, first: Column, last: Column | None = None) -> DataFrame:
    """Events from `first` to `last`, both included. Of stored ones only the folders of those dates are read."""
    kept = events.where(F.col("time") >= first)
    kept = kept if last is None else kept.where(F.col("time") <= last)
    if "event_date" in events.columns:
        kept = kept.where(F.col("event_date") >= F.to_date(first))
        kept = kept if last is None else kept.where(F.col("event_date") <= F.to_date(last))
    return kept


def _alert(findings: DataFrame) -> Column:
    """A finding as pruned JSON, without what only its place in the store tells."""
    schema = T.StructType([f for f in findings.schema.fields if f.name not in PARTITIONS.names])
    return prune_json(F.struct(*schema.names), schema)


def get_alerts(
    findings: DataFrame,
    start: str | None = None,
    end: str | None = None,
    *,
    file: Column | None = None,
    limit: int | None = PAGE,
) -> DataFrame:
    """Newest findings with start <= time <= end, by default of the last 24 hours.

    With ``limit=None`` all of them, in no order: a sort of the whole range helps nobody who pages.
    """
    now = datetime.now(timezone.utc)
    first = parse_time(start, now - timedelta(hours=24))
    last = parse_time(end, now)
    columns = [
        F.col("metadata.uid").alias("uid"),
        F.col("time"),
        F.col("finding_info.title").alias("title"),
        F.col("severity"),
        F.col("observables"),
        F.col("finding_info.uid").alias("finding_uid"),
    ]
    if file is not None:
        columns.append(file.alias("file"))
    found = in_range(findings, F.lit(first), F.lit(last)).select(*columns)
    return found if limit is None else found.orderBy(F.desc("time"), "uid", "finding_uid").limit(limit)


def fetch_alert(findings: DataFrame, uid: str) -> DataFrame:
    """The finding of an event id as pruned JSON; the first by finding id when there are several."""
    found = findings.where(F.col("metadata.uid") == uid)
    return (
        found.orderBy("finding_info.uid")
        .limit(1)
        .select(
            F.col("metadata.uid").alias("uid"),
            _alert(findings).alias("alert"),
        )
    )


def filter_alerts(alerts: DataFrame, severities: list[str] | None = None, search: str | None = None) -> DataFrame:
    """Severity in a set (an empty severity passes) and text in title or id, ignoring case."""
    if severities:
        severity = F.coalesce("severity", F.lit(""))
        alerts = alerts.where((severity == "") | severity.isin(severities))
    if search:
        needle = F.lit(search.lower())
        hit = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in ("title", "uid")]
        alerts = alerts.where(hit[0] | hit[1])
    return alerts


def severity_facets(alerts: DataFrame) -> DataFrame:
    return alerts.where("severity <> ''").select("severity").distinct().orderBy("severity")


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANKS for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.lower(severity)), F.lit(5))


def count_by_severity(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("severity").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "severity")
    )


def recent_events(events: DataFrame, hours: int = 24, limit: int = 100, *, now: datetime | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """Some events of the hours before `now`, newest first; `then` names columns that order equal times."""
    until = F.current_timestamp() if now is None else F.lit(now)
    since = until - F.expr(f"INTERVAL {int(hours)} HOURS")
    return in_range(events, since).where(F.col("time") > since).orderBy(F.desc("time"), *then).limit(limit)


def of_class(events: DataFrame, class_uid: int, limit: int = PAGE, *, then: tuple[str, ...] = ()) -> DataFrame:
    """The newest events of a class."""
    return events.where(F.col("class_uid") == class_uid).orderBy(F.desc("time"), *then).limit(limit)


def action_payloads(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Requests (request_id, alert_id, data) with `data` defaulting to the pruned alert.

    `error` tells why a request has no payload: no alert_id, or no such alert. Only findings that a
    request names are grouped, with a partial aggregate before the shuffle.
    """
    wanted = requests.where("alert_id IS NOT NULL").select(F.col("alert_id").alias("__uid")).distinct()
    key = F.col("metadata.uid").alias("__uid")
    alert = _alert(findings)
    named = findings.select(key, F.struct(*findings.columns).alias("f")).join(
        wanted, "__uid", "left_semi"
    )
    first = (
        named.groupBy("__uid")
        .agg(F.min_by("f", "f.finding_info.uid").alias("f"))
        .select("__uid", "f.*")
        .select("__uid", alert.alias("__alert"))
    )
    error = F.when(F.col("alert_id").isNull(), "missing alert_id").when(
        F.col("__alert").isNull(), "no such alert"
    )
    # Requests that name no alert would all meet in one task of the join.
    named_requests = requests.where("alert_id IS NOT NULL")
    nameless = requests.where("alert_id IS NULL").withColumn("__alert", F.lit(None).cast("string"))
    joined = named_requests.join(first, named_requests["alert_id"] == first["__uid"], "left").drop("__uid")
    return joined.unionByName(nameless).select(
        "request_id",
        "alert_id",
        F.when(error.isNull(), F.coalesce("data", "__alert")).alias("data"),
        error.alias("error"),
    )
