"""The streaming job: landed records to stored events, findings and quarantine.

Each micro-batch writes into folders of its own by overwrite, so a batch that is replayed after a
failure replaces its output: with the checkpoint this gives exactly-once tables. The same
DataFrame functions run in batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventlake.operators.correlate import Correlation
from eventlake.operators.detect import detect, event_time, usable_rules
from eventlake.operators.envelope import accepted
from eventlake.operators.idindex import index_batch
from eventlake.operators.route import store, store_findings
from eventlake.operators.rules import Rule
from eventlake.streaming.correlation import observed_fields, store_correlated

Normaliser = Callable[[DataFrame], DataFrame]
FindingSink = Callable[[DataFrame, int], None]


def without_repeats(events: DataFrame, delay: str) -> DataFrame:
    """Drop repeated event ids that arrive within `delay` of each other (streaming only)."""
    stamped = events.withColumn(
        "__seen", F.coalesce(event_time(F.col("data"), F.col("metadata")), F.current_timestamp())
    )
    return (
        stamped.withWatermark("__seen", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("__seen")
    )


def process_batch(
    landed: DataFrame,
    batch_id: int,
    *,
    base: str,
    quarantine: str,
    rules: Callable[[], list[Rule]],
    normalise: Normaliser | None = None,
    sink: FindingSink | None = None,
    schemas: dict[int, T.StructType] | None = None,
    on_refused_rule: Callable[[dict[str, str]], None] | None = None,
    correlations: Callable[[], list[Correlation]] = list,
    land: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Store the events of one batch, match them, store the findings and hand them downstream.

    `schemas` are the classes to store, with those of the user's own. A rule that does not compile is
    set aside for the batch and reported to `on_refused_rule`; the others run. The `correlations` then
    run over the stored findings around the batch's, and what they find is stored too. `land` makes landed
    rows of raw ones: `landing.land_pushed`, for one, numbers equal lines, which a stream by itself cannot.
    """
    if land:
        landed = land(landed)
    landed = landed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        refused = landed.where("reject_reason IS NOT NULL").select("event_id", "reject_reason", "raw")
        if not refused.isEmpty():
            refused.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}/part=landing")
        events = accepted(landed)
        if normalise:
            # Read by storing and by matching, so computed once.
            events = events.transform(normalise).persist(StorageLevel.MEMORY_AND_DISK)
        store(events, base, quarantine, schemas=schemas, batch_id=batch_id)
        usable, refused_rules = usable_rules(events, rules())  # rules are read anew for each batch
        if refused_rules and on_refused_rule:
            on_refused_rule(refused_rules)
        specs = correlations()
        findings = detect(events, usable, keep_metadata=True, observe=observed_fields(specs))
        if sink:  # matched once for both
            findings = findings.persist(StorageLevel.MEMORY_AND_DISK)
        store_findings(findings.drop("event_metadata"), base, batch_id)
        store_correlated(events.sparkSession, base, batch_id, specs)
        index_batch(events.sparkSession, base, batch_id)
        if sink:
            sink(findings, batch_id)
            findings.unpersist()
        if normalise:
            events.unpersist()
    finally:
        landed.unpersist()


def start_ingest(
    landed: DataFrame,
    *,
    base: str,
    quarantine: str,
    checkpoint: str,
    rules: Callable[[], list[Rule]],
    normalise: Normaliser | None = None,
    sink: FindingSink | None = None,
    schemas: dict[int, T.StructType] | None = None,
    on_refused_rule: Callable[[dict[str, str]], None] | None = None,
    correlations: Callable[[], list[Correlation]] = list,
    land: Callable[[DataFrame], DataFrame] | None = None,
    every: str | None = "5 minutes",
) -> StreamingQuery:
    """Run `process_batch` over a landed stream; `every=None` takes what is there and stops."""

    def run(batch: DataFrame, batch_id: int) -> None:
        process_batch(
            batch,
            batch_id,
            base=base,
            quarantine=quarantine,
            rules=rules,
            normalise=normalise,
            sink=sink,
            schemas=schemas,
            on_refused_rule=on_refused_rule,
            correlations=correlations,
            land=land,
        )

    writer = landed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def file_sink(path: str) -> FindingSink:
    """Downstream sink: findings as one JSON text per line, in a folder per batch."""

    def write(findings: DataFrame, batch_id: int) -> None:
        body = [c for c in findings.columns if c != "event_metadata"]
        findings.select(F.to_json(F.struct(*body)).alias("value")).write.mode("overwrite").text(
            f"{path}/batch_id={batch_id}"
        )

    return write


def kafka_sink(servers: str, topic: str) -> FindingSink:
    """Downstream sink: findings as keyed messages. Needs Spark's Kafka package on the class path."""

    def write(findings: DataFrame, batch_id: int) -> None:
        from eventlake.operators.route import finding_records

        finding_records(findings).write.format("kafka").option(
            "kafka.bootstrap.servers", servers
        ).option("topic", topic).save()

    return write


def read_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Message values with their position, ready for `push_events(position=...)`."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")
