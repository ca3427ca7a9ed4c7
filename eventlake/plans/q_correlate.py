"""Queries of correlation rules and the as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators.correlate import correlate, correlation_from_dict
from eventlake.operators.detect import match_rules, prepare_table
from eventlake.operators.timejoin import asof_join
from eventlake.plans.q_detect import rule
from eventlake.plans.registry import query
from eventlake.plans.tables import EV, typed_events

_RULES = [
    rule("err", sel={"event_type": "error"}),
    rule("buy", sel={"event_type": "purchase"}),
    rule("new", sel={"event_type": "signup"}),
]


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = typed_events(spark, sf_dir).withColumn("time", F.col("ts"))
    return match_rules(prepare_table(ev), _RULES, keep=["event_id", "user_id", "k", "time"])


def _spec(kind: str, rules: list[str], timespan: str, **condition) -> dict:
    body = {"type": kind, "rules": rules, "group-by": ["user_id"], "timespan": timespan}
    if condition:
        body["condition"] = condition
    return correlation_from_dict({"id": kind, "title": kind, "correlation": body})


def _out(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("time").alias("us"), "n")


@query(
    "corr_event_count",
    f"""WITH {EV} SELECT DISTINCT user_id, epoch_us(ts) AS us, n FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id
        ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM ev WHERE event_type = 'error') WHERE n >= 2""",
)
def corr_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(correlate(event_hits(spark, sf_dir), _spec("event_count", ["err"], "6h", gte=2)))


@query(
    "corr_value_count",
    f"""WITH {EV}, e AS (SELECT user_id, ts, k FROM ev WHERE event_type IN ('error', 'purchase'))
        SELECT a.user_id, epoch_us(a.ts) AS us, count(DISTINCT b.k) AS n FROM e a JOIN e b ON a.user_id = b.user_id
        AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts GROUP BY a.user_id, a.ts HAVING count(DISTINCT b.k) >= 3""",
)
def corr_value_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(correlate(event_hits(spark, sf_dir), _spec("value_count", ["err", "buy"], "1d", field="k", gte=3)))


@query(
    "corr_temporal",
    f"""WITH {EV}, e AS (SELECT user_id, ts, event_type FROM ev WHERE event_type IN ('error', 'purchase', 'signup'))
        SELECT a.user_id, epoch_us(a.ts) AS us, CAST(3 AS BIGINT) AS n FROM e a JOIN e b ON a.user_id = b.user_id
        AND b.ts BETWEEN a.ts - INTERVAL 12 HOURS AND a.ts GROUP BY a.user_id, a.ts HAVING count(DISTINCT b.event_type) = 3""",
)
def corr_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(correlate(event_hits(spark, sf_dir), _spec("temporal", ["err", "buy", "new"], "12h")))


@query(
    "corr_temporal_ordered",
    f"""WITH {EV} SELECT DISTINCT c.user_id, epoch_us(c.ts) AS us, CAST(3 AS BIGINT) AS n FROM ev a JOIN ev b ON a.user_id = b.user_id
        AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS JOIN ev c ON c.user_id = a.user_id AND c.ts >= b.ts
        AND c.ts <= a.ts + INTERVAL 12 HOURS
        WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND c.event_type = 'error'""",
)
def corr_temporal_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(correlate(event_hits(spark, sf_dir), _spec("temporal_ordered", ["new", "buy", "err"], "12h")))


@query(
    "asof_join",
    f"""WITH {EV}, l AS (SELECT event_id, user_id, ts FROM ev WHERE event_type = 'purchase'),
        r AS (SELECT user_id, ts, max(k) AS k FROM ev WHERE event_type = 'click' GROUP BY user_id, ts)
        SELECT l.event_id, epoch_us(r.ts) AS click_us, r.k FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts""",
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the same user's latest earlier click."""
    ev = typed_events(spark, sf_dir)
    joined = asof_join(
        ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts"),
        ev.where("event_type = 'click'").select("user_id", "ts", "k"),
        by=["user_id"],
        on="ts",
        take=["k"],
        inclusive=False,
    )
    return joined.select("event_id", F.unix_micros("right_ts").alias("click_us"), "k")
