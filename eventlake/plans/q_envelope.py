"""Queries over envelopes, payloads and source normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions.variants import get, json_or_text, kind, strict_string, wire_of, wire_value
from eventlake.operators.envelope import (
    from_json_values,
    from_matcher_event,
    lift_ingest_time,
    push_events,
    to_matcher_event,
    to_output_record,
)
from eventlake.operators.normalise import (
    detection_body,
    remap,
    tag_logsource,
    tag_source,
    unnest_records,
)
from eventlake.plans.registry import query
from eventlake.plans.tables import EV, model_events, table, typed_events
from eventlake.sources.registry import check_source_types, enrich_with_sources, merge_sources, normalise


def _meta(name: str) -> Column:
    return strict_string(F.try_element_at("metadata", F.lit(name)))


def landed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed record texts: mostly logs, with a metric, a trace, an empty and a malformed record in seven."""
    ev = typed_events(spark, sf_dir)
    ident = F.base64(F.unhex(F.lpad(F.lower(F.hex("event_id")), 32, "0")))
    meta = F.struct(
        F.struct(F.struct(F.lit("2024-02-01T00:00:00Z").alias("ingest_timestamp")).alias("vector")).alias("value"),
        F.lit("file").alias("source_type"),
        "source_id",
        ident.alias("source_event_id"),
    )
    as_value = F.to_json(F.struct(F.struct(F.col("props").alias("value"), meta.alias("metadata_full")).alias("log")))
    fields = F.struct("k", "event_type")
    as_fields = F.to_json(F.struct(F.struct(fields.alias("fields"), meta.alias("metadata_full")).alias("log")))
    text = (
        F.when(F.col("event_id") % 7 == 0, '{"metric":{"name":"m"}}')
        .when(F.col("event_id") % 7 == 1, '{"trace":{}}')
        .when(F.col("event_id") % 7 == 2, "{}")
        .when(F.col("event_id") % 7 == 3, F.concat(F.lit("not json "), "event_type"))
        .when(F.col("event_id") % 7 == 4, as_fields)
        .otherwise(as_value)
    )
    return ev.select("event_id", text.alias("value"))


_UUID = "lpad(lower(to_hex(event_id)), 32, '0')"
_UUID_TEXT = (
    f"substr({_UUID}, 1, 8) || '-' || substr({_UUID}, 9, 4) || '-' || substr({_UUID}, 13, 4) || '-' || "
    f"substr({_UUID}, 17, 4) || '-' || substr({_UUID}, 21, 12)"
)


@query(
    "envelope_parse",
    f"""WITH {EV} SELECT event_id AS row_id,
      CASE WHEN event_id % 7 >= 4 THEN {_UUID_TEXT} END AS event_uid,
      CASE WHEN event_id % 7 >= 4 THEN k END AS k,
      CASE WHEN event_id % 7 >= 4 THEN source_id END AS source_id,
      CASE WHEN event_id % 7 >= 4 THEN '2024-02-01T00:00:00Z' END AS ingest_time,
      CASE WHEN event_id % 7 >= 4 THEN {_UUID_TEXT} END AS correlation_uid,
      CASE event_id % 7 WHEN 0 THEN 'metric record' WHEN 1 THEN 'trace record' WHEN 2 THEN 'empty record'
        WHEN 3 THEN 'malformed record' END AS reject_reason
    FROM ev""",
)
def envelope_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = landed_records(spark, sf_dir).withColumnRenamed("event_id", "row_id")
    parsed = push_events(landed, position=("row_id",))
    ok = F.col("reject_reason").isNull()
    return parsed.select(
        "row_id",
        F.when(ok, F.col("event_id")).alias("event_uid"),
        F.when(ok, get(F.col("data"), "k", to="bigint")).alias("k"),
        F.when(ok, _meta("source_id")).alias("source_id"),
        F.when(ok, _meta("timestamp")).alias("ingest_time"),
        F.when(ok, _meta("correlation_uid")).alias("correlation_uid"),
        "reject_reason",
    )


@query(
    "payload_fallback",
    """SELECT doc AS kind, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM (
      SELECT CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN CAST(event_id AS VARCHAR)
             ELSE '"' || event_type || '"' END AS body,
             CASE event_id % 4 WHEN 0 THEN 'OBJECT' WHEN 2 THEN 'BIGINT' ELSE 'STRING' END AS doc
      FROM events) GROUP BY doc""",
)
def payload_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(
        "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN CAST(event_id AS STRING) "
        "ELSE '\"' || event_type || '\"' END"
    )
    df = table(spark, sf_dir, "events").select(body.alias("body"))
    name = F.regexp_extract(kind(json_or_text(F.col("body"))), "^[A-Z]+", 0)
    return df.groupBy(name.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars")
    )


@query(
    "ingest_time_lift",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2024-01-01T00:00:00Z' END AS stamp,
              event_id % 3 = 2 AS has_other, false AS has_collector FROM events""",
)
def ingest_time_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        """CASE event_id % 3 WHEN 0 THEN '{"vector":{"ingest_timestamp":"2024-01-01T00:00:00Z"}}'
           WHEN 1 THEN '{"vector":{"ingest_timestamp":17}}' ELSE '{"vector":"x","other":1}' END"""
    )
    meta = F.parse_json(text).cast("map<string,variant>")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", lift_ingest_time(meta).alias("metadata"))
        .select(
            "event_id",
            _meta("timestamp").alias("stamp"),
            F.map_contains_key("metadata", "other").alias("has_other"),
            F.map_contains_key("metadata", "vector").alias("has_collector"),
        )
    )


@query(
    "bare_values",
    "SELECT event_type AS activity, count(*) AS n, 0 AS entries FROM events GROUP BY event_type",
)
def bare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = typed_events(spark, sf_dir)
    data = F.to_variant_object(F.struct(F.col("event_type").alias("activity")))
    made = from_json_values(ev, data, ids=[F.col("event_id")])
    return made.groupBy(get(F.col("data"), "activity", to="string").alias("activity")).agg(
        F.count_distinct("event_id").alias("n"), F.max(F.size("metadata")).alias("entries")
    )


@query(
    "output_record",
    f"""WITH {EV} SELECT id AS event_id, k, CAST(class_uid AS BIGINT) AS class_uid, source_id, id AS correlation_uid,
        event_type AS service FROM ev""",
)
def output_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to_output_record(model_events(spark, sf_dir), restore_source=True)
    at = lambda path: F.get_json_object("record", "$." + path)
    return out.select(
        "event_id",
        at("fields.k").cast("bigint").alias("k"),
        at("fields.class_uid").cast("bigint").alias("class_uid"),
        at("metadata_full.source_id").alias("source_id"),
        at("metadata_full.value.correlation_uid").alias("correlation_uid"),
        at("metadata_full.value.logsource.service").alias("service"),
    )


@query(
    "matcher_event",
    f"""WITH {EV} SELECT event_id AS row_id, event_type AS service,
        CASE WHEN event_id % 2 = 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')
             ELSE id END AS event_uid FROM ev""",
)
def matcher_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr(
        "CASE WHEN event_id % 2 = 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(event_id AS STRING), 12, '0') "
        "ELSE 'no uuid' END"
    )
    ev = typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"),
        F.to_variant_object(F.struct("event_id")).alias("data"),
        F.create_map(
            F.lit("id"),
            given.cast("variant"),
            F.lit("logsource"),
            F.to_variant_object(F.struct(F.col("event_type").alias("service"))),
        ).alias("metadata"),
    )
    tagged = to_matcher_event(ev).withColumn("data", F.to_variant_object(
        F.struct(get(F.col("data"), "event_id", to="bigint").alias("row_id"), F.col("logsource.service").alias("service"))))
    back = from_matcher_event(tagged)
    return back.select(
        get(F.col("data"), "row_id", to="bigint").alias("row_id"),
        get(F.col("data"), "service", to="string").alias("service"),
        F.col("event_id").alias("event_uid"),
    )


@query(
    "wire_values",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '�' WHEN 1 THEN CAST(event_id AS VARCHAR)
              WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS text FROM events""",
)
def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    pick = F.col("event_id") % 4
    wire = F.struct(
        F.when(pick == 0, F.concat(F.col("event_type").cast("binary"), F.unhex(F.lit("FF")))).alias("raw"),
        F.when(pick == 1, F.col("event_id")).alias("int"),
        F.when(pick == 2, F.lit(float("nan"))).alias("dbl"),
        F.when(pick == 3, F.col("ts").cast("timestamp")).alias("ts"),
    )
    members = {"raw_bytes": "raw", "integer": "int", "float": "dbl", "timestamp": "ts"}
    return ev.select("event_id", wire.alias("w")).select(
        "event_id", F.try_variant_get(wire_value(F.col("w"), members), "$", "string").alias("text")
    )


@query(
    "wire_roundtrip",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'bytes ' || event_type WHEN 1 THEN 'integer ' || CAST(event_id AS VARCHAR)
        WHEN 2 THEN 'float 1.5' WHEN 3 THEN 'map' ELSE 'boolean true' END AS wire, true AS same FROM events""",
)
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values to wire kinds and back."""
    text = F.expr(
        """CASE event_id % 5 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN CAST(event_id AS STRING) WHEN 2 THEN '1.5'
           WHEN 3 THEN props ELSE 'true' END"""
    )
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v"))
    df = df.withColumn("w", wire_of(F.col("v")))
    shown = F.coalesce(
        F.concat(F.lit("bytes "), F.col("w.raw_bytes").cast("string")),
        F.concat(F.lit("integer "), F.col("w.integer").cast("string")),
        F.concat(F.lit("float "), F.col("w.float").cast("string")),
        F.concat(F.lit("boolean "), F.col("w.boolean").cast("string")),
        F.when(F.col("w.map").isNotNull(), "map"),
    )
    back = wire_value(F.col("w"), {n: n for n in ("raw_bytes", "boolean", "integer", "float", "map", "array")})
    return df.select("event_id", shown.alias("wire"), (F.to_json(back) == F.to_json("v")).alias("same"))


@query(
    "unnest_records",
    """SELECT event_type AS name, pos, count(*) AS n, CAST(sum(user_id + pos) AS BIGINT) AS total FROM (
      SELECT event_type, user_id, unnest(range(event_id % 3 + 1)) AS pos FROM events) GROUP BY event_type, pos""",
)
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = F.transform(
        F.sequence(F.lit(0), F.col("event_id") % 3),
        lambda i: F.struct(
            F.col("event_type").alias("eventName"), i.alias("pos"), (F.col("user_id") + i).alias("total")
        ),
    )
    ev = typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"),
        F.to_variant_object(F.struct(records.alias("Records"))).alias("data"),
        F.expr("cast(map() as map<string,variant>)").alias("metadata"),
    )
    flat = unnest_records(ev)
    return flat.groupBy(
        get(F.col("data"), "eventName", to="string").alias("name"),
        get(F.col("data"), "pos", to="bigint").alias("pos"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(get(F.col("data"), "total", to="bigint")).alias("total")
    )


@query(
    "tag_logsource",
    f"""WITH {EV} SELECT 'okta' AS vendor, 'audit' AS product, NULL AS service,
        'source-okta_' || source_id AS tagged, count(*) AS n FROM ev GROUP BY source_id""",
)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = model_events(spark, sf_dir)
    tagged = tag_source(tag_logsource(ev, vendor="okta", product="audit"), "okta", _meta("source_id"))
    tag = F.try_element_at("metadata", F.lit("sigma"))
    return tagged.groupBy(
        get(tag, "logsource", "vendor", to="string").alias("vendor"),
        get(tag, "logsource", "product", to="string").alias("product"),
        get(tag, "logsource", "service", to="string").alias("service"),
        _meta("source_id").alias("tagged"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "remap_ocsf",
    f"""WITH {EV} SELECT id AS event_id, 3002 AS class_uid, time_ms // 1000 AS time, CAST(user_id AS VARCHAR) AS user_name,
        '10.0.0.' || CAST(user_id AS VARCHAR) AS ip, event_type AS raw_activity, true AS marked FROM ev""",
)
def remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    uid = get(data, "user", "uid", to="string")
    out = remap(
        model_events(spark, sf_dir),
        {
            "class_uid": F.lit(3002),
            "time": F.floor(get(data, "time", to="bigint") / 1000),
            "user.name": uid,
            "src_endpoint.ip": F.concat(F.lit("10.0.0."), uid),
        },
    )
    return out.select(
        "event_id",
        get(data, "class_uid", to="int").alias("class_uid"),
        get(data, "time", to="bigint").alias("time"),
        get(data, "user", "name", to="string").alias("user_name"),
        get(data, "src_endpoint", "ip", to="string").alias("ip"),
        F.get_json_object(get(data, "raw_data", to="string"), "$.activity_name").alias("raw_activity"),
        F.map_contains_key("metadata", "ocsf").alias("marked"),
    )


@query(
    "body_selector",
    """SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN 'raw' ELSE 'data' END AS body FROM events""",
)
def body_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five: no mark; marked with raw text (twice, once marked false); bad raw text; raw object."""
    raw = F.expr(
        """CASE event_id % 5 WHEN 3 THEN '"raw_data":"{oops"' WHEN 4 THEN '"raw_data":{"src":"raw"}'
           ELSE '"raw_data":"{\\\\"src\\\\":\\\\"raw\\\\"}"' END"""
    )
    mark = F.expr("CASE event_id % 5 WHEN 0 THEN '{}' WHEN 2 THEN '{\"ocsf\":false}' ELSE '{\"ocsf\":true}' END")
    ev = table(spark, sf_dir, "events").select(
        "event_id",
        F.parse_json(F.concat(F.lit('{"src":"data",'), raw, F.lit("}"))).alias("data"),
        F.parse_json(mark).cast("map<string,variant>").alias("metadata"),
    )
    chosen = detection_body(F.col("data"), F.col("metadata"))
    return ev.select("event_id", get(chosen, "src", to="string").alias("body"))


@query(
    "source_cloudtrail",
    f"""WITH {EV} SELECT event_type AS operation, 'aws' AS product, 'cloudtrail' AS service, 6003 AS class_uid,
        CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS status,
        count(*) AS n, CAST(sum(time_ms // 1000) AS BIGINT) AS seconds FROM ev GROUP BY event_type""",
)
def cloudtrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = typed_events(spark, sf_dir)
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.col("event_type").alias("eventName"),
        F.struct(F.col("user_id").cast("string").alias("userName")).alias("userIdentity"),
        F.when(F.col("event_type") == "error", "Denied").alias("errorCode"),
        F.col("id").alias("eventID"),
    )
    files = F.to_json(F.struct(F.array(record).alias("Records")))
    landed = from_json_values(ev, F.parse_json(files), ids=[F.col("id")])
    out = normalise(landed, "aws_cloudtrail", "main")
    data, tag = F.col("data"), F.try_element_at("metadata", F.lit("sigma"))
    return out.groupBy(
        get(data, "api", "operation", to="string").alias("operation"),
        get(tag, "logsource", "product", to="string").alias("product"),
        get(tag, "logsource", "service", to="string").alias("service"),
        get(data, "class_uid", to="int").alias("class_uid"),
        get(data, "status", to="string").alias("status"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.floor(get(data, "time", to="bigint") / 1000)).alias("seconds"),
    )


@query(
    "source_okta",
    f"""WITH {EV} SELECT source_id, severity, 'audit' AS product, 'okta' AS vendor, count(*) AS n,
        count(DISTINCT user_id) AS users FROM ev GROUP BY source_id, severity""",
)
def okta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered sources of one type, merged."""
    ev = typed_events(spark, sf_dir)
    record = F.struct(
        F.col("id").alias("uuid"),
        "severity",
        F.col("event_type").alias("eventType"),
        F.struct(F.col("user_id").cast("string").alias("id"), F.col("source_id").alias("alternateId")).alias("actor"),
    )
    events = from_json_values(ev, F.to_variant_object(record), ids=[F.col("id")])
    main = F.col("severity_key") == "high"
    keyed = events.withColumn("severity_key", get(F.col("data"), "severity", to="string"))
    out = merge_sources(
        normalise(keyed.where(main).drop("severity_key"), "okta", "a"),
        normalise(keyed.where(~main).drop("severity_key"), "okta", "b"),
    )
    data, tag = F.col("data"), F.try_element_at("metadata", F.lit("sigma"))
    return out.groupBy(
        get(data, "user", "name", to="string").alias("source_id"),
        get(data, "severity", to="string").alias("severity"),
        get(tag, "logsource", "product", to="string").alias("product"),
        get(tag, "logsource", "vendor", to="string").alias("vendor"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(get(data, "user", "uid", to="string")).alias("users"),
    )


@query(
    "source_enrich",
    f"""WITH {EV} SELECT source_id, CASE WHEN source_id <> 'src-2' THEN 'okta' END AS source_type,
        CASE WHEN source_id <> 'src-2' THEN 'name of ' || source_id END AS source_name, count(*) AS n
        FROM ev GROUP BY source_id""",
)
def source_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = typed_events(spark, sf_dir)
    config = F.to_json(F.struct(F.concat(F.lit("name of "), "source_id").alias("name")))
    sources = (
        ev.select("source_id", F.lit("okta").alias("type"), config.alias("config"))
        .where("source_id <> 'src-2'")
        .distinct()
        .withColumnRenamed("source_id", "id")
    )
    return enrich_with_sources(ev.select("source_id"), sources).groupBy(
        "source_id", "source_type", "source_name"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_unsupported",
    "SELECT n_name AS id, 'type-' || CAST(n_regionkey AS VARCHAR) AS type FROM nation WHERE n_regionkey > 0",
)
def source_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind_of = F.when(F.col("n_regionkey") == 0, "okta").otherwise(
        F.concat(F.lit("type-"), F.col("n_regionkey").cast("string"))
    )
    return check_source_types(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), kind_of.alias("type"))
    )
