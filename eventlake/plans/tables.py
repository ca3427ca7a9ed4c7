"""The given tables as events: typed columns, or the (event_id, data, metadata) model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"] + [
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations"
]

# Class and severity of each kind of event; 99999 is a class nobody knows.
CLASS_CASE = (
    "CASE event_type WHEN 'signup' THEN 3001 WHEN 'purchase' THEN 6003 "
    "WHEN 'click' THEN 6001 WHEN 'view' THEN 4002 ELSE 99999 END"
)
SEVERITY_CASE = (
    "CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' "
    "WHEN 'signup' THEN 'low' ELSE 'informational' END"
)

# The same adapter for the SQL side.
EV = f"""ev AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS id, user_id, event_type, value, props, ts,
         {CLASS_CASE} AS class_uid, {SEVERITY_CASE} AS severity,
         epoch_us(ts) // 1000 AS time_ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         'src-' || CAST(user_id % 3 AS VARCHAR) AS source_id
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("id"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.expr(CLASS_CASE).alias("class_uid"),
        F.expr(SEVERITY_CASE).alias("severity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("src-"), (F.col("user_id") % 3).cast("string")).alias("source_id"),
    )


def model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the model, as a normalised source would deliver them."""
    body = F.struct(
        "class_uid",
        F.col("time_ms").alias("time"),
        "severity",
        F.col("event_type").alias("activity_name"),
        "value",
        "k",
        F.struct(F.col("user_id").cast("string").alias("uid")).alias("user"),
    )
    source = F.struct(F.lit("shop").alias("product"), F.col("event_type").alias("service"))
    return typed_events(spark, sf_dir).select(
        F.col("id").alias("event_id"),
        F.to_variant_object(body).alias("data"),
        F.create_map(
            F.lit("source_id"),
            F.col("source_id").cast("variant"),
            F.lit("logsource"),
            F.to_variant_object(source),
        ).alias("metadata"),
    )


def with_view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
