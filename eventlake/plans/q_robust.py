"""Every event arrives: extreme values, equal lines, findings from outside, classes of the user's own, replays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.model import CLASS_SCHEMAS
from eventlake.operators.detect import add_rules, detect, match_rules, prepare_table
from eventlake.operators.correlate import correlation_from_dict
from eventlake.operators.route import store_batch, store_findings
from eventlake.operators.rules import rule_table, rules_of_table
from eventlake.operators.triage import get_alerts
from eventlake.plans.adhoc import run_sql
from eventlake.plans.q_detect import rule
from eventlake.plans.registry import query
from eventlake.plans.tables import EV, model_events, table, typed_events
from eventlake.session import scratch_dir
from eventlake.sources.landing import read_hec, read_ndjson, read_pushed
from eventlake.sources.store import confined, file_column, read_class, read_findings, read_tree, register_views
from eventlake.streaming.ingest import file_sink, process_batch



def count_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


# Times that no clock gives, as JSON, by event_id modulo 6; the last is the event's own.
ODD_TIMES = ["-9223372036854775808", "9223372036854775807", '"1700000000000"', '"soon"', "null"]


def _odd_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.element_at(
        F.array(*map(F.lit, ODD_TIMES), F.col("time_ms").cast("string")), (F.col("event_id") % 6 + 1).cast("int")
    )
    text = F.concat(F.lit('{"class_uid":'), F.col("class_uid"), F.lit(',"k":'), F.col("k"), F.lit(',"time":'), time, F.lit("}"))
    return typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"), F.parse_json(text).alias("data"), F.expr("cast(map() as map<string,variant>)").alias("metadata")
    )


@query(
    "poison_events",
    f"""WITH {EV} SELECT 'stored' AS part, count(*) AS n FROM ev WHERE class_uid <> 99999
        UNION ALL SELECT 'aside', count(*) FROM ev WHERE class_uid = 99999
        UNION ALL SELECT 'stored with a time', count(*) FROM ev WHERE class_uid <> 99999 AND event_id % 6 IN (2, 5)
        UNION ALL SELECT 'findings', count(*) FROM ev WHERE k < 50
        UNION ALL SELECT 'findings with a time', count(*) FROM ev WHERE k < 50""",
)
def poison_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with impossible times: each is stored or set aside, and none stops the job."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    events = _odd_events(spark, sf_dir)
    store_batch(events, base, aside)
    stored = [read_class(spark, base, uid).select("time") for uid in (3001, 4002, 6001, 6003)]
    rows = stored[0].union(stored[1]).union(stored[2]).union(stored[3])
    found = detect(events, [rule("k", sel={"k|lt": 50})])
    parts = {
        "stored": rows,
        "stored with a time": rows.where("time IS NOT NULL"),
        "aside": read_tree(spark, aside),
        "findings": found,
        "findings with a time": found.where("time IS NOT NULL"),
    }
    counts = [df.agg(count_rows()).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3]).union(counts[4])


@query("ids_unique", "SELECT count(*) AS n, count(*) AS ids, count(DISTINCT props) AS texts FROM events")
def ids_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many equal lines in the same files: every line is an event with an id of its own."""
    landing = scratch_dir(spark, "landing")
    table(spark, sf_dir, "events").select("props").write.text(landing)
    lines = read_ndjson(spark, landing)
    return lines.agg(count_rows(), F.countDistinct("event_id").alias("ids"), F.countDistinct("raw").alias("texts"))


@query("source_ndjson", f"WITH {EV} SELECT user_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM ev GROUP BY user_id")
def source_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = scratch_dir(spark, "landing")
    typed_events(spark, sf_dir).select(F.to_json(F.struct("user_id", "k"))).write.text(landing)
    at = lambda name: F.try_variant_get("data", f"$.{name}", "bigint")
    return read_ndjson(spark, landing).groupBy(at("user_id").alias("user_id")).agg(count_rows(), F.sum(at("k")).alias("k"))


@query("source_hec", f"WITH {EV} SELECT event_type AS host, 'splunk_hec' AS source_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM ev GROUP BY event_type")
def source_hec(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = scratch_dir(spark, "landing")
    envelope = F.struct(F.col("event_type").alias("host"), F.struct("k").alias("event"))
    typed_events(spark, sf_dir).select(F.to_json(envelope)).write.text(landing)
    meta = lambda name: F.try_element_at("metadata", F.lit(name)).cast("string").alias(name)
    return read_hec(spark, landing).groupBy(meta("host"), meta("source_type")).agg(count_rows(), F.sum(F.try_variant_get("data", "$.k", "bigint")).alias("k"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(model_events(spark, sf_dir), [rule("low", level="low", sel={"k|lt": 10})])


@query(
    "alert_single_file",
    f"""WITH {EV}, low AS (SELECT CAST(make_timestamp(time_ms * 1000) AS DATE) AS day FROM ev WHERE k < 10)
        SELECT day, day = (SELECT max(day) FROM low) AS by_file, count(*) AS n FROM low GROUP BY day""",
)
def alert_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the last date read file by file, by names that rows of the table give; those of the other dates as a table."""
    base = scratch_dir(spark, "store")
    store_findings(_sample(spark, sf_dir), base)
    stored = read_findings(spark, base)
    last = stored.agg(F.max("event_date").alias("day")).first()["day"]
    day = F.to_date("time").alias("day")
    counts = stored.where(F.col("event_date") != F.lit(last)).groupBy(day).agg(F.lit(False).alias("by_file"), count_rows())
    mine = stored.where(F.col("event_date") == F.lit(last))
    names = [r["f"] for r in mine.select(file_column(base).alias("f")).distinct().collect()]  # the files of one date
    assert all(confined(base, name).startswith(base) for name in names)
    if names:
        files = reduce(DataFrame.union, [read_findings(spark, base, name) for name in names])
        counts = counts.union(files.groupBy(day).agg(F.lit(True).alias("by_file"), count_rows()))
    return counts


@query("store_external_findings", f"WITH {EV} SELECT severity, count(*) AS n, max(time_ms) AS latest FROM ev GROUP BY severity")
def store_external_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are findings already are stored with the findings."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    body = F.struct(F.lit(2004).alias("class_uid"), F.col("time_ms").alias("time"), "severity", F.col("event_type").alias("observables"))
    events = typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"), F.to_variant_object(body).alias("data"), F.expr("cast(map() as map<string,variant>)").alias("metadata")
    )
    store_batch(events, base, aside)
    found = read_findings(spark, base).where("observables IS NOT NULL")
    return found.groupBy("severity").agg(count_rows(), F.unix_millis(F.max("time")).alias("latest"))


OWN_CLASS = T.StructType([*CLASS_SCHEMAS[3001].fields[:5], T.StructField("k", T.LongType()), T.StructField("dst", T.StringType())])


@query("store_custom_class", f"WITH {EV} SELECT event_type AS dst, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM ev GROUP BY event_type")
def store_custom_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of the user's own, stored and read back through its view."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    schemas = CLASS_SCHEMAS | {4001: OWN_CLASS}
    body = F.struct(F.lit(4001).alias("class_uid"), F.col("time_ms").alias("time"), "k", F.col("event_type").alias("dst"))
    events = typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"), F.to_variant_object(body).alias("data"), F.expr("cast(map() as map<string,variant>)").alias("metadata")
    )
    store_batch(events, base, aside, schemas=schemas)
    register_views(spark, base, schemas)
    return run_sql(spark, "SELECT dst, count(*) AS n, sum(k) AS k FROM network_network_activity GROUP BY dst", 1000)


@query(
    "ingest_replay",
    f"""WITH {EV} SELECT 'events' AS part, count(*) AS n FROM ev UNION ALL SELECT 'findings', count(*) FROM ev WHERE k < 10
        UNION ALL SELECT 'sink', count(*) FROM ev WHERE k < 10""",
)
def ingest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch that runs twice leaves its output once: events, findings and what the sink got."""
    landing, base = scratch_dir(spark, "landing"), scratch_dir(spark, "store")
    aside, sent = scratch_dir(spark, "aside"), scratch_dir(spark, "sink")
    value = F.struct(F.lit(6003).alias("class_uid"), F.col("time_ms").alias("time"), "k", "event_id")
    record = F.struct(F.struct(F.to_json(value).alias("value")).alias("log"))
    typed_events(spark, sf_dir).select(F.to_json(record)).write.text(landing)
    for _ in range(2):
        process_batch(
            read_pushed(spark, landing), 0, base=base, quarantine=aside,
            rules=lambda: [rule("low", sel={"k|lt": 10}), rule("bad", sel={"k|re": "("})], sink=file_sink(sent),
        )
    parts = {"events": read_class(spark, base, 6003), "findings": read_findings(spark, base), "sink": spark.read.option("recursiveFileLookup", "true").text(sent)}
    counts = [df.agg(count_rows()).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query(
    "alerts_pruned",
    f"""WITH {EV} SELECT CAST(to_timestamp(0) AS DATE) < CAST(ts AS DATE) AS later, count(*) AS n FROM ev
        WHERE k < 10 AND time_ms BETWEEN 1704844800000 AND 1705017600000 GROUP BY 1""",
)
def alerts_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings of two days: only the folders of those dates are read."""
    base = scratch_dir(spark, "store")
    store_findings(_sample(spark, sf_dir), base)
    found = get_alerts(read_findings(spark, base), "2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z", limit=None)
    return found.groupBy((F.col("time") > F.timestamp_seconds(F.lit(0))).alias("later")).agg(count_rows())


@query(
    "rule_add",
    f"""WITH {EV} SELECT rule_id, count(*) AS n FROM (SELECT 'old' AS rule_id FROM ev WHERE event_type = 'error'
        UNION ALL SELECT 'new' FROM ev WHERE event_type = 'signup' AND k < 50) GROUP BY rule_id
        UNION ALL SELECT unnest(['bad pattern', 'bad condition', 'bad modifier', 'old']), CAST(0 AS BIGINT)""",
)
def rule_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rules join the rule table when they compile and their id is free; hits of the table, and the refused ids with 0."""
    old = rule_table(spark, [rule("old", sel={"event_type": "error"})])
    made = [
        rule("new", sel={"event_type": "signup", "k|lt": 50}), rule("old", sel={"event_type": "click"}), rule("bad pattern", sel={"event_type|re": "("}),
        rule("bad condition", condition="sel and nobody", sel={"k": 1}), rule("bad modifier", sel={"k|sounds": 1}),
    ]
    rules, refused = add_rules(old, rule_table(spark, made))
    hits = match_rules(prepare_table(typed_events(spark, sf_dir)), rules_of_table(rules))
    return hits.groupBy("rule_id").agg(count_rows()).union(refused.select("id", F.lit(0).cast("long")))


@query(
    "findings_correlated",
    f"""WITH {EV}, met AS (
          SELECT DISTINCT 'seq' AS rule_id, c.user_id, c.time_ms FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.time_ms BETWEEN a.time_ms AND a.time_ms + 43200000
          JOIN ev c ON c.user_id = a.user_id AND c.time_ms >= b.time_ms AND c.time_ms <= a.time_ms + 43200000
          WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND c.event_type = 'error'
          UNION ALL SELECT DISTINCT 'many', user_id, time_ms FROM (SELECT user_id, time_ms, count(*) OVER (PARTITION BY user_id
          ORDER BY time_ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE event_type = 'error') WHERE n >= 2)
        SELECT rule_id, CASE rule_id WHEN 'seq' THEN 'Signup to error' ELSE 'Many errors' END AS title, CASE rule_id WHEN 'seq' THEN 'high' ELSE 'low' END AS severity,
               CAST(user_id AS VARCHAR) AS user, time_ms, count(*) OVER () AS total FROM met""",
)
def findings_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations as rules of the ingest: three batches in no order of time, one replayed; each finding once."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    rules = [rule(i, sel={"activity_name": kind}) for i, kind in (("err", "error"), ("buy", "purchase"), ("new", "signup"))]
    body = {"group-by": ["user.uid"], "timespan": "12h"}
    specs = [
        correlation_from_dict({"id": "seq", "title": "Signup to error", "level": "high", "correlation": {"type": "temporal_ordered", "rules": ["new", "buy", "err"], **body}}),
        correlation_from_dict({"id": "many", "title": "Many errors", "level": "low", "correlation": {"type": "event_count", "rules": "err", **body, "timespan": "6h", "condition": {"gte": 2}}}),
    ]
    landed = model_events(spark, sf_dir).select("*", F.lit(None).cast("string").alias("reject_reason"), F.lit(None).cast("string").alias("raw"))
    for batch in (0, 1, 2, 1):
        mine = landed.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch)
        process_batch(mine, batch, base=base, quarantine=aside, rules=lambda: rules, correlations=lambda: specs)
    found = read_findings(spark, base).where(F.col("rule_id").isin("seq", "many"))
    user = F.get_json_object("metadata.correlation_uid", "$['user.uid']").alias("user")
    rows = found.select("rule_id", F.col("finding_info.title").alias("title"), "severity", user, F.unix_millis("time").alias("time_ms"))
    return rows.withColumn("total", F.lit(found.count()).cast("long"))
