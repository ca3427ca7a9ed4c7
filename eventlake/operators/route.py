"""Route events by class and store them: one Parquet table per class below category/class.

Rows without a usable class, and rows their class's schema rejects, go to a quarantine table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.variants import get, kind
from eventlake.model import CLASS_SCHEMAS, CLASSES, FINDING_CLASS_UID, FINDING_SCHEMA, class_dimension, class_path
from eventlake.operators.coerce import accepted_rows, coerce
from eventlake.session import remove_dir, scratch_dir

# Writer settings: v2 pages and Snappy; a Bloom filter on the id that alerts are looked up by.
WRITE_OPTIONS = {"compression": "snappy", "parquet.writer.version": "v2"}
FINDING_WRITE_OPTIONS = {
    "parquet.bloom.filter.enabled#metadata.uid": "true",
    "parquet.bloom.filter.expected.ndv#metadata.uid": "1000000",
}
JOBS_AT_ONCE = 8
# Shuffled bytes that one task of a write takes at most. Stored rows are wide and mostly empty: 8 MB of them,
# compressed, were 300 MB to sort.
WRITE_BYTES = 8 << 20
# Mark of the batch folders of findings that arrive as events.
INCOMING = "in-"
# Mark of the batch folders of findings that correlations made.
CORRELATED = "corr-"
# Annotations kept with every stored column set.
CREATED_BY = "eventlake"


def class_uid_of(data: Column) -> Column:
    """The non-negative JSON integer at `class_uid`, NULL for anything else."""
    value = get(data, "class_uid")
    number = F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(number >= 0, number)


def route(events: DataFrame, schemas: dict[int, T.StructType] | None = None) -> DataFrame:
    """Add class_uid, category, class_name and a reject_reason for events that cannot be stored."""
    dim = F.broadcast(class_dimension(events.sparkSession, schemas))  # fixed size: the known classes
    known = events.withColumn("class_uid", class_uid_of(F.col("data"))).join(dim, "class_uid", "left")
    reason = (
        F.when(F.col("class_uid").isNull(), "no usable class_uid")
        .when(F.col("class_name").isNull(), "unknown class_uid")
        .when(~F.col("has_schema"), "no schema for class")
    )
    return known.select(
        *events.columns, "class_uid", "category", "class_name", reason.alias("reject_reason")
    )


def _target(base: str, class_uid: int, batch_id: int | None, part: str = "") -> str:
    return f"{base}/{class_path(class_uid)}/batch_id={part}{'all' if batch_id is None else batch_id}"


def describe(df: DataFrame, class_uid: int) -> DataFrame:
    """Attach the class's description to the columns; Parquet keeps it with the schema."""
    note = f"{dict(CLASSES)[class_uid]} ({class_uid}), written by {CREATED_BY}"
    return df.select(*[F.col(c).alias(c, metadata={"comment": note}) for c in df.columns])


@contextmanager
def bounded_writes(spark: SparkSession) -> Iterator[None]:
    """Rebalance to parts of `WRITE_BYTES` at most: a date of any size is sorted in tasks of bounded memory."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = spark.conf.get(key)
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", given.strip().lower()).groups()
    spark.conf.set(key, str(min(int(number) << 10 * " kmgtp".index(unit or " "), WRITE_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def write_class(df: DataFrame, base: str, class_uid: int, batch_id: int | None = None, part: str = "") -> None:
    """Write coerced rows of one class, in a folder for each date, so that a time range opens few files.

    Rows are brought together by date first: few files for a quiet date, several for a busy one. They
    are sorted by time within a file, so time ranges skip row groups. A batch writes its own folder by
    overwrite, so that a replay replaces its output.
    """
    dated = describe(df, class_uid).withColumn("event_date", F.to_date("time")).hint("rebalance", "event_date")
    writer = dated.sortWithinPartitions("event_date", "time").write.partitionBy("event_date").options(**WRITE_OPTIONS)
    if class_uid == FINDING_CLASS_UID:
        writer = writer.options(**FINDING_WRITE_OPTIONS)
    mode = "append" if batch_id is None else "overwrite"
    writer.mode(mode).parquet(_target(base, class_uid, batch_id, part))


def quarantine_rows(df: DataFrame, class_uid: Column | None = None) -> DataFrame:
    uid = F.col("class_uid") if class_uid is None else class_uid
    return df.select(
        "event_id",
        uid.cast("bigint").alias("class_uid"),
        "reject_reason",
        F.to_json("data").alias("raw"),
    )


def _write_quarantine(df: DataFrame, path: str, part: str, batch_id: int | None) -> None:
    target = f"{path}/part={part}" if batch_id is None else f"{path}/batch_id={batch_id}/part={part}"
    df.write.mode("append" if batch_id is None else "overwrite").parquet(target)


def store(
    events: DataFrame,
    base: str,
    quarantine: str,
    *,
    schemas: dict[int, T.StructType] | None = None,
    batch_id: int | None = None,
    staging: str | None = None,
) -> dict[int, int]:
    """Coerce and write all events; returns the stored rows per class.

    A large batch job passes `staging`, a folder all executors share: routed rows are written there
    once, partitioned by class, and each class then reads only its own part. Without it the routed
    rows are persisted, which suits the bounded batches of a stream.
    """
    spark = events.sparkSession
    schemas = {FINDING_CLASS_UID: FINDING_SCHEMA} | (CLASS_SCHEMAS if schemas is None else schemas)
    routed = route(events, schemas).select("event_id", "data", "class_uid", "reject_reason")
    if staging:
        (
            routed.withColumn("part", F.when(F.col("reject_reason").isNull(), F.col("class_uid")))
            .write.partitionBy("part")
            .mode("overwrite")
            .parquet(staging)
        )
        routed = spark.read.parquet(staging)
        parts = routed
        usable = F.col("part").isNotNull()
    else:
        routed = routed.persist(StorageLevel.MEMORY_AND_DISK)
        parts = routed.withColumn("part", F.col("class_uid"))
        usable = F.col("reject_reason").isNull()
    try:
        present = parts.where(usable).groupBy("part").count().collect()  # at most the known classes

        def store_class(uid: int, count: int) -> int:
            mine = parts.where(usable & (F.col("part") == uid))
            coerced = coerce(mine.drop("reject_reason"), schemas[uid])
            seen = Observation()
            counted = coerced.observe(seen, F.count("reject_reason").alias("rejected"))
            # Findings from outside lie beside those of `store_findings`, which replaces its own folder.
            part = INCOMING if uid == FINDING_CLASS_UID else ""
            write_class(accepted_rows(counted), base, uid, batch_id, part)
            rejected = seen.get["rejected"]
            if rejected:
                bad = coerced.where("reject_reason IS NOT NULL")
                _write_quarantine(quarantine_rows(bad), quarantine, str(uid), batch_id)
            return count - rejected

        # The classes' jobs do not depend on each other: submitted together, small classes fill the
        # executors that the last tasks of a large one leave idle.
        work = inheritable_thread_target(spark)(store_class)
        with bounded_writes(spark), ThreadPoolExecutor(max_workers=JOBS_AT_ONCE) as pool:
            jobs = {int(r["part"]): pool.submit(work, int(r["part"]), r["count"]) for r in present}
        stored = {uid: job.result() for uid, job in jobs.items() if uid in schemas}
        unusable = parts.where(~usable)
        if not unusable.isEmpty():
            _write_quarantine(quarantine_rows(unusable), quarantine, "unrouted", batch_id)
        return stored
    finally:
        if not staging:
            routed.unpersist()


def store_findings(findings: DataFrame, base: str, batch_id: int | None = None, part: str = "") -> None:
    """Write findings to their class. An empty result leaves no folder, also none of an earlier attempt."""
    if findings.isEmpty():
        if batch_id is not None:  # nothing is written, but an earlier attempt's folder goes
            remove_dir(findings.sparkSession, _target(base, FINDING_CLASS_UID, batch_id, part))
        return
    with bounded_writes(findings.sparkSession):
        write_class(findings, base, FINDING_CLASS_UID, batch_id, part)


def store_batch(events: DataFrame, base: str, quarantine: str, **options) -> dict[int, int]:
    """`store` for a whole table, staged in the session's shared folder. The staged copy is deleted afterwards."""
    spark = events.sparkSession
    staging = scratch_dir(spark, "stage")
    try:
        return store(events, base, quarantine, staging=staging, **options)
    finally:
        remove_dir(spark, staging)


def export(df: DataFrame, scope: str = "all") -> DataFrame:
    """Rows a downstream sink gets: 'all', or 'alerts' for findings only."""
    if scope not in ("all", "alerts"):
        raise ValueError(f"unknown scope {scope!r}")
    return df if scope == "all" else df.where(F.col("class_uid") == FINDING_CLASS_UID)


def finding_records(findings: DataFrame) -> DataFrame:
    """Findings as key/value text for a message or file sink."""
    body = [c for c in findings.columns if c != "event_metadata"]
    return findings.select(
        F.col("finding_info.uid").alias("key"), F.to_json(F.struct(*body)).alias("value")
    )
