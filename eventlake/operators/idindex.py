"""Index from an event's id to the files of its findings, so that a lookup opens few files.

Every batch leaves a small segment, `_ids/batch/…`, sorted by id. A merge turns the segments of batches
into one whose rows lie in buckets by hash, sorted by id within a bucket, and now and then all segments
into one. A segment counts once its success marker is there; the ones it replaces are deleted then. In
between a row may be found twice, which changes nothing: what the index gives are file names, and only
those that the store still has are opened. Files that a compaction has moved are followed by its snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.model import FINDING_CLASS_UID, class_path
from eventlake.operators.route import CORRELATED, INCOMING
from eventlake.operators.triage import fetch_alert
from eventlake.sources.manifest import PACKED, Folder
from eventlake.sources.store import read_files, read_findings

BATCH, MERGED = "_ids/batch", "_ids/merged"
SCHEMA = "uid string, folder string, name string"
WRITE_OPTIONS = {"parquet.bloom.filter.enabled#uid": "true", "parquet.bloom.filter.expected.ndv#uid": "1000000"}
# Ids of a bucket, and merged segments that a lookup goes through at most.
BUCKET_ROWS, SEGMENTS = 1_000_000, 4


def _folder(spark: SparkSession, base: str) -> Folder:
    return Folder(spark, f"{base}/{class_path(FINDING_CLASS_UID)}")


def index_batch(spark: SparkSession, base: str, batch_id: int | None = None) -> None:
    """Index the findings a batch has written: its own, those that came in as events and those of correlations.

    A replay replaces its segment.
    """
    folder = _folder(spark, base)
    name = "all" if batch_id is None else str(batch_id)
    files = [f for part in ("", INCOMING, CORRELATED) for f in folder.files(f"batch_id={part}{name}/event_date=*/*.parquet")]
    segment = f"{BATCH}/segment={name}"
    if not files:
        folder.remove(segment)
        return
    folders = sorted({f.folder for f in files})
    rows = read_files(spark, folder.root, FINDING_CLASS_UID, folders, name="name")
    place = F.concat(F.lit("batch_id="), F.col("batch_id"), F.lit("/event_date="), F.coalesce(F.col("event_date").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    ids = rows.select(F.col("metadata.uid").alias("uid"), place.alias("folder"), "name").where("uid IS NOT NULL").distinct()
    ids.repartitionByRange("uid").sortWithinPartitions("uid").write.options(**WRITE_OPTIONS).mode("overwrite").parquet(f"{folder.root}/{segment}")


def _segments(folder: Folder) -> tuple[list[str], list[str]]:
    """(segments of batches, merged segments) that are complete."""
    batches = [p.rsplit("/", 1)[0] for p, _, _ in folder.glob(f"{BATCH}/segment=*/_SUCCESS")]
    merged = [p.rsplit("/", 1)[0] for p, _, _ in folder.glob(f"{MERGED}/version=*/of=*/_SUCCESS")]
    return batches, sorted(merged, key=lambda p: int(p.split("version=")[1].split("/")[0]))


def merge_index(spark: SparkSession, base: str) -> str | None:
    """Merge the segments of batches into a bucketed one, and all of them once there are `SEGMENTS`; the new one."""
    folder = _folder(spark, base)
    batches, merged = _segments(folder)
    parts = batches + (merged if len(merged) + 1 >= SEGMENTS else [])
    if not batches:
        return None
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*[f"{folder.root}/{p}" for p in parts])
    buckets = -(-rows.count() // BUCKET_ROWS) or 1
    version = max([0, *folder.versions(MERGED)]) + 1
    segment = f"{MERGED}/version={version}/of={buckets}"
    placed = rows.distinct().withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    writer = placed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "uid").write
    writer.partitionBy("bucket").options(**WRITE_OPTIONS).parquet(f"{folder.root}/{segment}")
    for part in parts:
        folder.remove(part)
    return segment


@dataclass
class Lookup:
    """What a lookup has opened."""

    index_files: int
    finding_files: list[str]


def find_files(spark: SparkSession, base: str, uid: str) -> Lookup:
    """The files, relative to the class, that hold findings of an event."""
    folder = _folder(spark, base)
    batches, merged = _segments(folder)
    paths = list(batches)
    for segment in merged:
        buckets = int(segment.rsplit("of=", 1)[1])
        bucket = spark.sql(f"SELECT pmod(xxhash64(:uid), {buckets})", args={"uid": uid}).first()[0]
        paths.append(f"{segment}/bucket={bucket}")
    opened = [p for path in paths for p, _, _ in folder.glob(f"{path}/*.parquet")]
    if not opened:
        return Lookup(0, [])
    rows = spark.read.schema(SCHEMA).parquet(*[f"{folder.root}/{p}" for p in opened])
    places = [f"{r.folder}/{r.name}" for r in rows.where(F.col("uid") == uid).distinct().collect()]  # files of one event's findings
    snapshot = folder.snapshot()
    if snapshot is not None:
        live = {f"{f.folder}/{f.name}" for f in snapshot.live}
        now = {snapshot.moved.get(p, p) for p in places}
        places = [p for p in now if p in live or p.split("/")[0] not in {*snapshot.batches, PACKED}]
    return Lookup(len(opened), [p for p in sorted(places) if folder.glob(p)])


def fetch_indexed(spark: SparkSession, base: str, uid: str) -> tuple[DataFrame, Lookup]:
    """`fetch_alert` of an event id over nothing but the files that hold it, and what was opened."""
    lookup = find_files(spark, base, uid)
    if not lookup.finding_files:
        return fetch_alert(read_findings(spark, None), uid), lookup
    findings = read_files(spark, f"{base}/{class_path(FINDING_CLASS_UID)}", FINDING_CLASS_UID, lookup.finding_files)
    return fetch_alert(findings, uid), lookup
