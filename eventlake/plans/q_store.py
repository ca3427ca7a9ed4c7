"""Queries of coercion, routing and storing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.variants import get
from eventlake.model import CLASS_SCHEMAS, class_path
from eventlake.operators.coerce import coerce
from eventlake.operators.compact import compact, expire
from eventlake.operators.normalise import remap
from eventlake.operators.route import export, route, store_batch, store_findings
from eventlake.plans.q_detect import rule, sample_findings
from eventlake.plans.q_envelope import landed_records
from eventlake.plans.registry import query
from eventlake.plans.sample_rules import HITS
from eventlake.plans.tables import EV, model_events, table, typed_events
from eventlake.session import scratch_dir
from eventlake.sources.landing import land_pushed, read_pushed, read_text
from eventlake.sources.store import file_column, read_class, read_findings, read_tree
from eventlake.streaming.ingest import start_ingest


def _json_rows(spark: SparkSession, sf_dir: str, member: str, cases: list[str]) -> DataFrame:
    """event_id, user_id and JSON data whose member takes one of seven spellings by event_id."""
    arms = " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(cases))
    text = F.expr(f"concat('{{', CASE event_id % 7 {arms} END, '\"zz\":1}}')")
    return table(spark, sf_dir, "events").select(
        "event_id", F.parse_json(text).alias("data")
    )


def _coerced(df: DataFrame, **fields: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(n, t, True) for n, t in fields.items()])
    return coerce(df, schema).select("event_id", "row.*", "reject_reason")


@query(
    "coerce_int",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN user_id END AS i,
        CASE event_id % 7 WHEN 0 THEN user_id WHEN 1 THEN 99999999999 END AS l, NULL AS reject_reason FROM events""",
)
def coerce_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = ["user_id", "'99999999999'", "'1.0'", "'\"1\"'", "'null'", None, "'true'"]
    cases = ["''" if s is None else f"concat('\"i\":', {s}, ',\"l\":', {s}, ',')" for s in spell]
    return _coerced(_json_rows(spark, sf_dir, "i", cases), i=T.IntegerType(), l=T.LongType())


@query(
    "coerce_number",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN 1.5 WHEN 2 THEN 1000.0 END AS d,
        CASE event_id % 7 WHEN 5 THEN true WHEN 6 THEN false END AS b, NULL AS reject_reason FROM events""",
)
def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = ["user_id", "'1.5'", "'1e3'", "'\"1.5\"'", "'\"true\"'", "'true'", "'false'"]
    cases = [f"concat('\"d\":', {s}, ',\"b\":', {s}, ',')" for s in spell]
    return _coerced(_json_rows(spark, sf_dir, "d", cases), d=T.DoubleType(), b=T.BooleanType())


@query(
    "coerce_string",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'true'
        WHEN 3 THEN '{"k":[1]}' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE '[1,"x"]' END AS s, NULL AS reject_reason FROM events""",
)
def coerce_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [
        "concat('\"s\":\"', event_type, '\",')", "concat('\"s\":', user_id, ',')", "'\"s\":true,'",
        "'\"s\":{\"k\":[1]},'", "'\"s\":null,'", "''", "'\"s\":[1,\"x\"],'",
    ]
    return _coerced(_json_rows(spark, sf_dir, "s", cases), s=T.StringType())


@query(
    "coerce_ts",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN epoch_us(ts) // 1000 WHEN event_id % 7 = 2 THEN -5 END AS ms,
        NULL AS reject_reason FROM events""",
)
def coerce_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = "unix_millis(CAST(ts AS TIMESTAMP))"
    cases = [
        f"concat('\"t\":', {ms}, ',')", f"concat('\"t\":\"', {ms}, '\",')", "'\"t\":\"-5\",'", "'\"t\":\" 17 \",'",
        "'\"t\":\"2024-01-01T00:00:00Z\",'", "'\"t\":1.5,'", "'\"t\":null,'",
    ]
    out = _coerced(_json_rows(spark, sf_dir, "t", cases), t=T.TimestampType())
    return out.select("event_id", F.unix_millis("t").alias("ms"), "reject_reason")


@query(
    "coerce_struct",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type END AS a, event_id % 7 IN (0, 1, 2, 3) AS stored,
        CASE WHEN event_id % 7 > 3 THEN 'expected object for ''st''' END AS reject_reason FROM events""",
)
def coerce_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object, with a wrong member, empty, missing; then null, text and array, which reject."""
    cases = [
        "concat('\"st\":{\"a\":\"', event_type, '\",\"zz\":1},')", "'\"st\":{\"a\":null},'", "'\"st\":{},'", "''",
        "'\"st\":null,'", "'\"st\":\"x\",'", "'\"st\":[1],'",
    ]
    inner = T.StructType([T.StructField("a", T.StringType(), True)])
    out = _coerced(_json_rows(spark, sf_dir, "st", cases), st=inner)
    ok = F.col("reject_reason").isNull()
    return out.select(
        "event_id",
        F.when(ok, F.col("st.a")).alias("a"),
        (F.col("st").isNotNull() & ok).alias("stored"),
        "reject_reason",
    )


@query(
    "coerce_list",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '1,' || CAST(user_id AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN 'null,4' END AS items,
        CASE WHEN event_id % 7 IN (4, 5) THEN 'expected array for ''ar''' WHEN event_id % 7 = 6 THEN 'unusable element of ''os'''
        END AS reject_reason FROM events""",
)
def coerce_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [
        "concat('\"ar\":[1,', user_id, '],')", "'\"ar\":[],'", "'\"ar\":[\"x\",4],'", "''",
        "'\"ar\":null,'", "'\"ar\":\"x\",'", "'\"os\":[{\"a\":\"q\"},null],'",
    ]
    inner = T.StructType([T.StructField("a", T.StringType(), True)])
    out = _coerced(_json_rows(spark, sf_dir, "ar", cases), ar=T.ArrayType(T.IntegerType()), os=T.ArrayType(inner))
    items = F.array_join(F.transform("ar", lambda x: x.cast("string")), ",", "null")
    return out.select(
        "event_id", F.when(F.col("reject_reason").isNull(), items).alias("items"), "reject_reason"
    )


@query(
    "coerce_required",
    """SELECT CASE event_id % 7 WHEN 1 THEN 'missing required field ''req''' WHEN 2 THEN 'unusable value for ''req'''
        WHEN 3 THEN 'unusable value for ''num''' WHEN 4 THEN 'expected object at top level'
        WHEN 5 THEN 'missing required field ''num''' END AS reject_reason, count(*) AS n FROM events GROUP BY 1""",
)
def coerce_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """CASE event_id % 7 WHEN 1 THEN '{"num":1}' WHEN 2 THEN '{"req":null,"num":1}' WHEN 3 THEN '{"req":"x","num":"1"}'
           WHEN 4 THEN '[1]' WHEN 5 THEN '{"req":"x"}' ELSE '{"req":7,"num":1}' END"""
    )
    schema = T.StructType(
        [T.StructField("req", T.StringType(), False), T.StructField("num", T.IntegerType(), False)]
    )
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("data"))
    return coerce(df, schema).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


_ROUTES = """SELECT CASE WHEN class_uid = 99999 THEN NULL WHEN class_uid = 3001 THEN 'iam' WHEN class_uid = 4002 THEN 'network'
    ELSE 'application' END AS category, CASE class_uid WHEN 3001 THEN 'account_change' WHEN 4002 THEN 'http_activity'
    WHEN 6001 THEN 'web_resources_activity' WHEN 6003 THEN 'api_activity' END AS class_name, count(*) AS n"""


@query("route_counts", f"WITH {EV} {_ROUTES} FROM ev GROUP BY class_uid")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(model_events(spark, sf_dir))
    return routed.groupBy("category", "class_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "route_quarantine",
    """SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 5 THEN 'unknown class_uid' WHEN 6 THEN 'no schema for class'
        ELSE 'no usable class_uid' END AS reject_reason, count(*) AS n FROM events GROUP BY 1""",
)
def route_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """concat('{', CASE event_id % 7 WHEN 0 THEN '"class_uid":3002' WHEN 1 THEN '"class_uid":"3002"' WHEN 2 THEN '"class_uid":-1'
           WHEN 3 THEN '"class_uid":3002.0' WHEN 4 THEN '"zz":1' WHEN 5 THEN '"class_uid":4294970298' ELSE '"class_uid":4001' END, '}')"""
    )
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("data"))
    return route(df).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "store_roundtrip",
    f"""WITH {EV} SELECT class_uid, count(*) AS n, CAST(sum(time_ms) AS BIGINT) AS ms, CAST(sum(k) AS BIGINT) AS k,
        count(DISTINCT user_id) AS users FROM ev WHERE class_uid <> 99999 GROUP BY class_uid""",
)
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every event to its class, read all classes back."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    store_batch(model_events(spark, sf_dir), base, aside)
    both = None
    for uid in CLASS_SCHEMAS:
        part = read_class(spark, base, uid).select("class_uid", "time", "k", "user") if "k" in CLASS_SCHEMAS[uid].fieldNames() else None
        both = part if both is None else (both if part is None else both.unionByName(part))
    return both.groupBy("class_uid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.unix_millis("time")).alias("ms"),
        F.sum("k").alias("k"),
        F.count_distinct("user.uid").alias("users"),
    )


@query(
    "store_quarantine",
    f"""WITH {EV} SELECT id AS event_id, class_uid, CASE WHEN class_uid = 99999 THEN 'unknown class_uid'
        ELSE 'expected object for ''user''' END AS reject_reason FROM ev WHERE class_uid = 99999 OR user_id < 10""",
)
def store_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unroutable events and those their schema rejects: nothing gets lost."""
    user = F.when(F.col("user_id") < 10, F.lit("7").cast("variant")).otherwise(
        F.to_variant_object(F.struct(F.col("id").alias("uid")))
    )
    ev = typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"),
        F.to_variant_object(F.struct("class_uid", user.alias("user"))).alias("data"),
    )
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    store_batch(ev, base, aside)
    return read_tree(spark, aside).select("event_id", "class_uid", "reject_reason")


@query(
    "store_findings",
    f"""WITH {EV}, {HITS} SELECT rule_id, count(*) AS n, 'findings/detection_finding/batch_id=all/event_date=' || strftime(ts, '%Y-%m-%d') AS folder
        FROM hits GROUP BY rule_id, folder""",
)
def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "store")
    store_findings(sample_findings(spark, sf_dir), base)
    read = read_findings(spark, base).withColumn(
        "folder", F.regexp_extract(file_column(base), "^(.*)/[^/]*$", 1)
    )
    return read.groupBy("rule_id", "folder").agg(F.count(F.lit(1)).alias("n"))


@query(
    "export_alerts",
    f"""WITH {EV}, {HITS} SELECT 2004 AS class_uid, count(*) AS n FROM hits""",
)
def export_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = typed_events(spark, sf_dir).select(F.col("class_uid"), F.timestamp_millis("time_ms").alias("time"))
    both = raw.unionByName(sample_findings(spark, sf_dir).select("class_uid", "time"))
    return export(both, "alerts").groupBy("class_uid").agg(F.count(F.lit(1)).alias("n"))


_STREAMED = """SELECT '6003' AS part, json_extract_string(props, '$.k') AS detail, {n} * count(*) AS n FROM events WHERE event_id % 7 IN (5, 6) GROUP BY detail
    UNION ALL SELECT 'finding', 'low', {n} * count(*) FROM events WHERE event_id % 7 IN (5, 6) AND CAST(json_extract_string(props, '$.k') AS BIGINT) < 10
    UNION ALL SELECT 'aside', NULL, {n} * count(*) FROM events WHERE event_id % 7 < 5"""


def _streamed(spark: SparkSession, lines: DataFrame, **ingest) -> DataFrame:
    """Landed lines through the streaming job: stored rows by their value, findings by rule, and refused rows."""
    landing, base = scratch_dir(spark, "landing"), scratch_dir(spark, "store")
    aside, mark = scratch_dir(spark, "aside"), scratch_dir(spark, "mark")
    lines.write.text(landing)
    landed = read_text(spark, landing, streaming=True, max_files=100) if "land" in ingest else read_pushed(spark, landing, streaming=True, max_files=100)

    def to_class(events: DataFrame) -> DataFrame:
        # Records with fields instead of a payload name no class here.
        uid = F.when(get(F.col("data"), "event_type").isNull(), F.lit(6003))
        return remap(events, {"class_uid": uid, "k": get(F.col("data"), "k", to="bigint")})

    rules = [rule("low", sel={"k|lt": 10, "event_type|exists": False})]
    start_ingest(landed, base=base, quarantine=aside, checkpoint=mark, rules=lambda: rules, normalise=to_class, every=None, **ingest).awaitTermination()
    parts = [
        ("6003", F.col("k").cast("string"), read_class(spark, base, 6003)),
        ("finding", F.col("rule_id"), read_findings(spark, base)),
        ("aside", F.lit(None).cast("string"), read_tree(spark, aside)),
    ]
    counts = [df.groupBy(F.lit(name).alias("part"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("n")) for name, detail, df in parts]
    return reduce(DataFrame.union, counts)


@query("stream_equals_batch", _STREAMED.format(n=1))
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed records through the streaming job."""
    return _streamed(spark, landed_records(spark, sf_dir).select("value"))


@query("stream_repeats", _STREAMED.format(n=2))
def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is sent twice, as equal lines of one file: both are events of their own."""
    lines = landed_records(spark, sf_dir).select("value")
    return _streamed(spark, lines.union(lines).repartition(4, "value"), land=land_pushed)


@query(
    "store_compacted",
    f"""WITH {EV}, stage AS (SELECT unnest(['before', 'during', 'after', 'expired']) AS stage)
        SELECT stage, CAST(make_timestamp(time_ms * 1000) AS DATE) AS day, count(*) AS n, CAST(sum(time_ms) AS BIGINT) AS total FROM ev, stage
        WHERE event_type = 'purchase' GROUP BY stage, day""",
)
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of four batches, counted before, during and after its compaction, and once the old files are gone."""
    base, aside = scratch_dir(spark, "store"), scratch_dir(spark, "aside")
    events = model_events(spark, sf_dir).where("try_variant_get(data, '$.class_uid', 'int') = 6003")
    for batch in range(4):
        store_batch(events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch), base, aside, batch_id=batch)
    counts = []

    def count(stage: str) -> None:
        stored = read_class(spark, base, 6003)
        total = F.sum(F.unix_millis("time")).alias("total")
        rows = stored.groupBy(F.col("event_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), total).withColumn("stage", F.lit(stage))
        path = scratch_dir(spark, "count")
        rows.write.parquet(path)
        counts.append(spark.read.parquet(path))

    count("before")
    compact(spark, base, 6003, before_commit=lambda: count("during"))
    count("after")
    expire(spark, base, 6003, grace_seconds=0)
    count("expired")
    return reduce(DataFrame.union, counts).select("stage", "day", "n", "total")
