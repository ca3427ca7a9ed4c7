"""Compaction of a stored class: many small files of many batches into few large ones, readers undisturbed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventlake.model import FINDING_CLASS_UID, class_path
from eventlake.operators.route import FINDING_WRITE_OPTIONS, WRITE_OPTIONS
from eventlake.sources.manifest import APPENDED, MANIFEST, PACKED, SNAPSHOT_SCHEMA, Folder, Snapshot, StoredFile
from eventlake.sources.store import Schemas, read_files

TARGET_BYTES = 128 << 20
KEPT_SNAPSHOTS = 2


def pack(files: list[StoredFile], target: int) -> list[list[StoredFile]]:
    """Files of one date in bins of at most `target` bytes: the largest first, each into the first bin it fits."""
    bins: list[tuple[list[StoredFile], list[int]]] = []
    for f in sorted(files, key=lambda f: (-f.bytes, f)):
        room = next((b for b in bins if b[1][0] >= f.bytes), None)
        if room is None:
            bins.append(([f], [target - f.bytes]))
        else:
            room[0].append(f)
            room[1][0] -= f.bytes
    return [b for b, _ in bins]


def _rewrite(spark: SparkSession, folder: Folder, class_uid: int, bins: list[list[StoredFile]], version: int, schemas: Schemas | None) -> dict[str, str]:
    """Write each bin as one file, sorted by time; returns where the rows of each old file are now."""
    places = [(f.date.split("=", 1)[1], f.name, i) for i, files in enumerate(bins) for f in files]
    where = spark.createDataFrame(places, "__date string, __name string, __bin int")
    rows = read_files(spark, folder.root, class_uid, [f"{f.folder}/{f.name}" for files in bins for f in files], schemas, name="__file")
    date = F.coalesce(F.col("event_date").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    # A file name is one task of one job, so with the date it is unique. The table of places is as long as the list of files.
    placed = rows.withColumn("__date", date).join(F.broadcast(where), (F.col("__file") == F.col("__name")) & (date == where["__date"]))
    placed = placed.select(*[c for c in rows.columns if c != "__file"], "__bin")
    writer = placed.repartitionById(len(bins), "__bin").drop("__bin").sortWithinPartitions("event_date", "time").write
    writer = writer.partitionBy("event_date").options(**WRITE_OPTIONS)
    if class_uid == FINDING_CLASS_UID:
        writer = writer.options(**FINDING_WRITE_OPTIONS)
    target = f"{PACKED}/version={version}"
    writer.parquet(f"{folder.root}/{target}")
    written = {(int(f.name.split("-")[1]), f.date): f for f in folder.files(f"{target}/event_date=*/*.parquet")}
    moved = {}
    for i, files in enumerate(bins):
        for f in files:
            new = written[i, f.date]
            moved[f"{f.folder}/{f.name}"] = f"{new.folder}/{new.name}"
    return moved


def compact(
    spark: SparkSession,
    base: str,
    class_uid: int,
    *,
    target: int = TARGET_BYTES,
    settled: Callable[[str], bool] = lambda batch: True,
    schemas: Schemas | None = None,
    before_commit: Callable[[], None] = lambda: None,
) -> int | None:
    """Pack the small files of a class and commit a snapshot; its version, or None where nothing gains.

    Files of half the target and more stay where they are. Only batches for which `settled` holds are taken: a
    stream passes the batches that its checkpoint has committed. Readers see the class as before until
    the snapshot is committed, and a compaction that fails leaves files that nobody reads. One compaction
    of a class runs at a time.
    """
    folder = Folder(spark, f"{base}/{class_path(class_uid)}")
    old = folder.snapshot() or Snapshot()
    fresh = [f for f in folder.open_files(old) if settled(f.folder.split("/")[0].split("=", 1)[1])]
    small = [f for f in {*fresh, *old.live} if f.bytes < target // 2]
    by_date: dict[str, list[StoredFile]] = {}
    for f in small:
        by_date.setdefault(f.date, []).append(f)
    bins = [b for date in sorted(by_date) for b in pack(by_date[date], target) if len(b) > 1]
    if not bins:
        return None
    version = max([0, *folder.versions(PACKED), *folder.versions(MANIFEST)]) + 1
    moved = _rewrite(spark, folder, class_uid, bins, version, schemas)
    gone = {f for b in bins for f in b}
    new = Snapshot(version, {f for f in {*old.live, *fresh} if f not in gone}, set(old.batches), set(old.files))
    new.live |= set(folder.files(f"{PACKED}/version={version}/event_date=*/*.parquet"))
    for f in fresh:
        batch = f.folder.split("/")[0]
        if batch == APPENDED:
            new.files.add((f.folder, f.name))
        else:
            new.batches.add(batch)
    # An older place leads straight to the newest one.
    new.moved = {place: moved.get(now, now) for place, now in old.moved.items()} | moved
    before_commit()
    spark.createDataFrame(new.rows(), SNAPSHOT_SCHEMA).coalesce(1).write.parquet(f"{folder.root}/{MANIFEST}/version={version}")
    return version


def expire(spark: SparkSession, base: str, class_uid: int, grace_seconds: float) -> int:
    """Delete files that no reader of the newest snapshot needs, once it is older than the grace time; their number.

    The grace time is that of the longest reader: one that began before the snapshot still reads them.
    Covered batches stay listed, so that a replay of one is not taken for a new batch.
    """
    folder = Folder(spark, f"{base}/{class_path(class_uid)}")
    snapshot = folder.snapshot()
    if snapshot is None:
        return 0
    (_, _, committed), *_ = folder.glob(f"{MANIFEST}/version={snapshot.version}/_SUCCESS")
    if time.time() - committed / 1000 < grace_seconds:
        return 0
    live = {(f.folder, f.name) for f in snapshot.live}
    files = folder.files("batch_id=*/event_date=*/*.parquet")
    dead = [f for f in files if f.folder.split("/")[0] in snapshot.batches or (f.folder, f.name) in snapshot.files]
    dead += [f for f in folder.files(f"{PACKED}/version=*/event_date=*/*.parquet") if int(f.folder.split("version=")[1].split("/")[0]) <= snapshot.version]
    dead = [f for f in dead if (f.folder, f.name) not in live]
    for f in dead:
        folder.remove(f"{f.folder}/{f.name}")
    for version in folder.versions(MANIFEST):
        if version <= snapshot.version - KEPT_SNAPSHOTS:
            folder.remove(f"{MANIFEST}/version={version}")
    return len(dead)
