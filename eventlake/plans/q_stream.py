"""Queries that run as streams over the given tables until all input is taken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators.envelope import accepted, push_events
from eventlake.operators.sessions import sessions, stream_sessions
from eventlake.plans.q_correlate import _spec
from eventlake.plans.registry import ORACLES, query
from eventlake.plans.tables import EV, table, typed_events
from eventlake.session import scratch_dir
from eventlake.streaming.correlation import windowed_counts
from eventlake.streaming.ingest import without_repeats
from eventlake.streaming.sequence import stream_sequences


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def run_out(spark: SparkSession, stream: DataFrame, path: str, mark: str) -> None:
    """Run a stream to the end of what there is."""
    job = stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(path)
    job.awaitTermination()


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream to its end into a table, and read that."""
    path = scratch_dir(spark, "out")
    run_out(spark, stream, path, scratch_dir(spark, "mark"))
    return spark.read.schema(stream.schema).parquet(path)


def closed(spark: SparkSession, hits: DataFrame, correlated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a correlation over a stream of hits to its end, its last windows included.

    After the hits, restarts from the checkpoint take a hit of no rule each from a second folder. Its time,
    beyond all others, lets the watermark pass whatever is still open; where one state feeds another, the
    second lets go at the second such hit.
    """
    path, mark, folder = (scratch_dir(spark, x) for x in ("out", "mark", "close"))

    def end(time: str) -> DataFrame:
        values = {"rule_id": "end of stream", "time": time}
        return spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in hits.schema])

    end("9000-01-01").limit(0).write.parquet(folder)
    out = correlated(hits.union(spark.readStream.schema(hits.schema).parquet(folder)))
    run_out(spark, out, path, mark)
    for time in ("9000-01-01", "9001-01-01"):
        end(time).write.mode("append").parquet(folder)
        run_out(spark, out, path, mark)
    return spark.read.schema(out.schema).parquet(path)


@query(
    "stream_without_repeats",
    "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type",
)
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record delivered twice is kept once."""
    record = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), "event_id", "event_type").alias("value")
            ).alias("log")
        )
    )
    twice = events_stream(spark, sf_dir).select(
        F.explode(F.array(record, record)).alias("value")
    )
    once = without_repeats(accepted(push_events(twice)), "1 hour")
    kind = F.try_variant_get("data", "$.event_type", "string")
    return drained(spark, once.select(kind.alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_WINDOWED = f"""WITH {EV}, h AS (SELECT user_id, k, ts, epoch_us(ts) // 86400000000 AS day FROM ev WHERE event_type IN ('error', 'purchase'))
    SELECT user_id, day * 86400 AS start, {{count}} AS n FROM h GROUP BY user_id, day HAVING {{count}} >= 3"""


def hits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit for each event, of the rule that watches its kind."""
    return events_stream(spark, sf_dir).select(
        F.col("event_type").alias("rule_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.col("ts").cast("timestamp").alias("time"),
    )


def _windowed(spark: SparkSession, sf_dir: str, kind: str, **condition) -> DataFrame:
    spec = _spec(kind, ["error", "purchase"], "1d", gte=3, **condition)
    out = closed(spark, hits_stream(spark, sf_dir), lambda hits: windowed_counts(hits, spec, "10 minutes"))
    return out.select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("stream_event_count", _WINDOWED.format(count="count(*)"))
def stream_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per user and day, emitted once the watermark has closed the day; the last ones at the end."""
    return _windowed(spark, sf_dir, "event_count")


@query("stream_value_count", _WINDOWED.format(count="count(DISTINCT k)"))
def stream_value_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir, "value_count", field="k")


@query("stream_temporal_ordered", ORACLES["corr_temporal_ordered"])
def stream_temporal_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup, purchase, error of a user within 12 hours, by keyed state: the same rows as in batch."""
    spec = _spec("temporal_ordered", ["signup", "purchase", "error"], "12h")
    out = closed(spark, hits_stream(spark, sf_dir), lambda hits: stream_sequences(hits, spec, "10 minutes"))
    return out.select("user_id", F.unix_micros("time").alias("us"), "n")


@query("stream_temporal", ORACLES["corr_temporal"])
def stream_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _spec("temporal", ["signup", "purchase", "error"], "12h")
    out = closed(spark, hits_stream(spark, sf_dir), lambda hits: stream_sequences(hits, spec, "10 minutes"))
    return out.select("user_id", F.unix_micros("time").alias("us"), "n")


_SESSIONS = f"""WITH {EV}, h AS (SELECT user_id, epoch_us(ts) AS us FROM ev WHERE event_type IN ('error', 'purchase')),
    b AS (SELECT *, coalesce(us - lag(us) OVER w > 21600000000, true) AS fresh FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY us) AS nth FROM b)
    SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, nth"""


def _watched(hits: DataFrame) -> DataFrame:
    """Hits of the two rules; the condition names the time, so that marks still move the watermark."""
    return hits.where(F.when(F.col("time").isNotNull(), F.col("rule_id").isin("error", "purchase")))


def _flat_sessions(found: DataFrame) -> DataFrame:
    return found.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("last_us"), "n")


@query("sessions_batch", _SESSIONS)
def sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of errors and purchases of a user with pauses of six hours at most."""
    hits = typed_events(spark, sf_dir).select(F.col("event_type").alias("rule_id"), "user_id", F.col("ts").alias("time"))
    return _flat_sessions(sessions(hits.where(F.col("rule_id").isin("error", "purchase")), ["user_id"], 21_600))


@query("sessions_stream", _SESSIONS)
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream, open sessions included."""
    return _flat_sessions(closed(spark, hits_stream(spark, sf_dir), lambda hits: stream_sessions(hits, ["user_id"], 21_600, "10 minutes", before=_watched)))
