"""Queries of alert triage and ad-hoc SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions.prune import prune_json
from eventlake.model import FINDING_CLASS_UID
from eventlake.operators.compact import compact, expire
from eventlake.operators.idindex import fetch_indexed, index_batch, merge_index
from eventlake.operators.route import store_batch, store_findings
from eventlake.operators.triage import (
    action_payloads,
    count_by_severity,
    fetch_alert,
    filter_alerts,
    get_alerts,
    of_class,
    recent_events,
    severity_facets,
    severity_rank,
)
from eventlake.plans.adhoc import as_json, run_sql
from eventlake.plans.q_detect import sample_findings
from eventlake.plans.registry import query
from eventlake.plans.sample_rules import HITS
from eventlake.plans.tables import EV, model_events, table, typed_events, with_view
from eventlake.session import scratch_dir
from eventlake.sources.store import read_findings, register_views

_UID = "sha256(id || chr(1) || rule_id)"
_ALERTS = f"SELECT id AS uid, time_ms, title, level AS severity, {_UID} AS finding_uid FROM hits"


def _flat(alerts: DataFrame) -> DataFrame:
    return alerts.select("uid", F.unix_millis("time").alias("time_ms"), "title", "severity", "finding_uid")


@query(
    "alerts_top10",
    f"""WITH {EV}, {HITS} {_ALERTS} WHERE time_ms BETWEEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00')
        AND epoch_ms(TIMESTAMP '2024-01-20 00:00:00') ORDER BY time_ms DESC, uid, finding_uid LIMIT 10""",
)
def alerts_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_findings(spark, sf_dir)
    return _flat(get_alerts(found, "2024-01-05T00:00:00Z", "2024-01-20T02:00:00+02:00"))


@query(
    "alerts_range_inclusive",
    f"""WITH {EV}, {HITS}, edge AS (SELECT min(time_ms) AS a, max(time_ms) AS b FROM ev WHERE event_type = 'error' AND value >= 100)
        {_ALERTS}, edge WHERE time_ms BETWEEN a AND b""",
)
def alerts_range_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings exactly at either end are in."""
    found = sample_findings(spark, sf_dir)
    edge = found.where("rule_id = 'r0'").agg(F.min("time").alias("a"), F.max("time").alias("b")).first()
    if edge["a"] is None:
        return _flat(get_alerts(found.where("false"), None, None, limit=None))
    text = [t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z" for t in (edge["a"], edge["b"])]
    return _flat(get_alerts(found, *text, limit=None))


_FIRST = "SELECT id, rule_id FROM hits WHERE id = (SELECT min(id) FROM hits WHERE rule_id = 'r1') ORDER BY " + _UID + " LIMIT 1"


@query(
    "alert_fetch",
    f"""WITH {EV}, {HITS}, one AS ({_FIRST}) SELECT h.id AS uid, h.rule_id, h.title, h.level AS severity, false AS has_observables
        FROM hits h JOIN one ON h.id = one.id AND h.rule_id = one.rule_id""",
)
def alert_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup in the stored findings; several findings of the event give the first."""
    base = scratch_dir(spark, "store")
    found = sample_findings(spark, sf_dir)
    store_findings(found, base)
    stored = read_findings(spark, base)
    uid = stored.where("rule_id = 'r1'").agg(F.min("metadata.uid").alias("u")).first()["u"]
    row = fetch_alert(stored, uid or "")
    at = lambda path: F.get_json_object("alert", "$." + path)
    return row.select(
        "uid",
        at("rule_id").alias("rule_id"),
        at("finding_info.title").alias("title"),
        at("severity").alias("severity"),
        F.contains("alert", F.lit("observables")).alias("has_observables"),
    )


@query(
    "alert_filter",
    f"""WITH {EV}, {HITS}, alerts AS ({_ALERTS}) SELECT uid, title, severity, 'both' AS filter FROM alerts
        WHERE (severity IS NULL OR severity IN ('high', 'low')) AND (contains(lower(title), 'click') OR contains(lower(uid), 'click') OR contains(lower(title), 'key'))
        AND contains(lower(title), 'c')
        UNION ALL SELECT uid, title, severity, 'id' FROM alerts WHERE contains(uid, '77') OR contains(title, '77')""",
)
def alert_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = sample_findings(spark, sf_dir).select(
        F.col("metadata.uid").alias("uid"), F.col("finding_info.title").alias("title"), "severity"
    )
    severe = filter_alerts(alerts, ["high", "low"], "C")
    either = filter_alerts(severe, None, "CLICK").unionByName(
        filter_alerts(severe, None, "key").where("NOT contains(lower(title), 'click')")
    )
    return either.withColumn("filter", F.lit("both")).unionByName(
        filter_alerts(alerts, None, "77").withColumn("filter", F.lit("id"))
    )


@query(
    "alert_facets",
    f"WITH {EV}, {HITS} SELECT DISTINCT level AS severity FROM hits WHERE level <> ''",
)
def alert_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_facets(sample_findings(spark, sf_dir))


@query(
    "severity_counts",
    f'WITH {EV}, {HITS} SELECT level AS severity, count(*) AS "count" FROM hits GROUP BY level',
)
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_severity(sample_findings(spark, sf_dir))


@query(
    "severity_ranks",
    f"""WITH {EV}, {HITS} SELECT CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
        WHEN 'informational' THEN 4 ELSE 5 END AS rank, count(*) AS n FROM hits GROUP BY 1""",
)
def severity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = sample_findings(spark, sf_dir).select(severity_rank(F.upper("severity")).alias("rank"))
    return ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prune_json",
    """SELECT event_id, '{' || CASE WHEN event_id % 2 = 0 THEN '"a":' || CAST(user_id AS VARCHAR) || ',' ELSE '' END
        || CASE WHEN event_id % 3 = 0 THEN '"b":{"c":"' || event_type || '"},' ELSE '' END
        || CASE WHEN event_id % 5 = 0 THEN '"e":[1],' ELSE '' END
        || '"f":[null],"g":[{}],"h":1}' AS json FROM events""",
)
def pruned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, emptied objects and empty arrays go; array elements stay, even null or emptied."""
    ev = table(spark, sf_dir, "events")
    on = lambda n, value: F.when(F.col("event_id") % n == 0, value)
    row = ev.select(
        "event_id",
        F.struct(
            on(2, F.col("user_id")).alias("a"),
            F.struct(on(3, F.col("event_type")).alias("c")).alias("b"),
            F.coalesce(on(5, F.array(F.lit(1))), F.array().cast("array<int>")).alias("e"),
            F.array(F.lit(None).cast("string")).alias("f"),
            F.array(F.struct(F.lit(None).cast("string").alias("z"))).alias("g"),
            F.lit(1).alias("h"),
        ).alias("r"),
    )
    return row.select("event_id", prune_json(F.col("r"), row.schema["r"].dataType).alias("json"))


@query(
    "action_payload",
    f"""WITH {EV}, {HITS}, req AS (SELECT event_id AS request_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE id END AS alert_id,
          CASE WHEN event_id % 7 = 0 THEN 'given' END AS data FROM ev),
        first AS (SELECT id, rule_id FROM (SELECT id, rule_id, row_number() OVER (PARTITION BY id ORDER BY {_UID}) AS rn FROM hits) WHERE rn = 1)
        SELECT request_id, alert_id, CASE WHEN first.id IS NOT NULL THEN coalesce(data, rule_id) END AS what,
          CASE WHEN alert_id IS NULL THEN 'missing alert_id' WHEN first.id IS NULL THEN 'no such alert' END AS error
        FROM req LEFT JOIN first ON alert_id = first.id""",
)
def action_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = typed_events(spark, sf_dir)
    requests = ev.select(
        F.col("event_id").alias("request_id"),
        F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE id END").alias("alert_id"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'given' END").alias("data"),
    )
    out = action_payloads(requests, sample_findings(spark, sf_dir))
    what = F.coalesce(F.get_json_object("data", "$.rule_id"), F.col("data"))
    return out.select("request_id", "alert_id", what.alias("what"), "error")


@query("adhoc_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def adhoc_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_view(spark, sf_dir, "customer")
    return run_sql(spark, "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey; ")


@query("adhoc_own_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def adhoc_own_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_view(spark, sf_dir, "orders")
    return run_sql(spark, "WITH o AS (SELECT * FROM orders) SELECT o_orderkey FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")


@query(
    "adhoc_json",
    """SELECT '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '","none":null}' AS json
       FROM orders""",
)
def adhoc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("none"))
    return as_json(df)


@query(
    "adhoc_views",
    f"""WITH {EV} SELECT 'class' AS view, class_uid, count(*) AS n FROM ev WHERE class_uid = 6003 GROUP BY class_uid
        UNION ALL SELECT 'category', class_uid, count(*) FROM ev WHERE class_uid IN (6001, 6003) GROUP BY class_uid
        UNION ALL SELECT 'all', class_uid, count(*) FROM ev WHERE class_uid <> 99999 GROUP BY class_uid""",
)
def adhoc_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored classes under their view names: one class, a category, everything."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    store_batch(model_events(spark, sf_dir), base, aside)
    register_views(spark, base)
    return run_sql(
        spark,
        """SELECT 'class' AS view, class_uid, count(*) AS n FROM application_api_activity GROUP BY class_uid
           UNION ALL SELECT 'category', class_uid, count(*) FROM application_all GROUP BY class_uid
           UNION ALL SELECT 'all', class_uid, count(*) FROM all_events GROUP BY class_uid""",
        limit=100,
    )


@query(
    "class_filter",
    f"WITH {EV} SELECT event_id, class_uid FROM ev WHERE class_uid = 3001 ORDER BY ts DESC, event_id LIMIT 10",
)
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = typed_events(spark, sf_dir).withColumnRenamed("ts", "time")
    return of_class(events, 3001, then=("event_id",)).select("event_id", "class_uid")


@query(
    "recent_events",
    f"""WITH {EV} SELECT event_id FROM ev WHERE class_uid = 3001 AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS
        ORDER BY ts DESC, event_id LIMIT 100""",
)
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of a class, counted from the newest event instead of the clock."""
    events = typed_events(spark, sf_dir).withColumnRenamed("ts", "time")
    newest = events.agg(F.max("time")).first()[0]
    return recent_events(events.where("class_uid = 3001"), now=newest, then=("event_id",)).select("event_id")


@query(
    "alert_fetch_indexed",
    f"""WITH {EV}, {HITS}, u AS (SELECT DISTINCT unnest([low, high]) AS uid FROM (SELECT min(id) AS low, max(id) AS high FROM hits)),
        r AS (SELECT h.*, row_number() OVER (PARTITION BY id ORDER BY {_UID}) AS nth FROM hits h JOIN u ON u.uid = h.id)
        SELECT id AS uid, rule_id, title, level AS severity, 1 AS index_files, 1 AS finding_files FROM r WHERE nth = 1""",
)
def alert_fetch_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups over the id index of findings that came in batches and were compacted; with the files opened."""
    base = scratch_dir(spark, "store")
    found = sample_findings(spark, sf_dir)
    for batch in range(3):
        store_findings(found.where(F.pmod(F.xxhash64("metadata.uid"), F.lit(3)) == batch), base, batch)
        index_batch(spark, base, batch)
    merge_index(spark, base)
    compact(spark, base, FINDING_CLASS_UID)
    expire(spark, base, FINDING_CLASS_UID, grace_seconds=0)
    ends = read_findings(spark, base).agg(F.min("metadata.uid").alias("low"), F.max("metadata.uid").alias("high")).first()
    at = lambda path: F.get_json_object("alert", "$." + path)
    rows = []
    for uid in sorted({ends["low"] or "", ends["high"] or ""}):
        row, opened = fetch_indexed(spark, base, uid)
        rows.append(
            row.select(
                "uid", at("rule_id").alias("rule_id"), at("finding_info.title").alias("title"), at("severity").alias("severity"),
                F.lit(opened.index_files).alias("index_files"), F.lit(len(opened.finding_files)).alias("finding_files"),
            )
        )
    return reduce(DataFrame.union, rows)
