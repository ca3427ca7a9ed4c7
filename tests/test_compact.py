"""Compaction: the same rows at every moment, few files, replays and crashes without effect."""

import random

import pytest
from pyspark.sql import functions as F

from eventlake.model import FINDING_CLASS_UID, class_path
from eventlake.operators.compact import compact, expire, pack
from eventlake.operators.route import store
from eventlake.session import scratch_dir
from eventlake.sources.manifest import Folder, StoredFile
from eventlake.sources.store import read_class

UID = 6003


def write(spark, base, batch, days, rows=6, start=0):
    """A batch of events over some days."""
    body = F.struct(
        F.lit(UID).alias("class_uid"), (F.lit(1_700_000_000_000) + F.col("id") % days * 86_400_000).alias("time"),
        F.struct(F.concat(F.lit(f"b{batch}-"), F.col("id")).alias("uid")).alias("metadata"),
    )
    events = spark.range(start, start + rows).select(
        F.col("id").cast("string").alias("event_id"), F.to_variant_object(body).alias("data"), F.expr("cast(map() as map<string,variant>)").alias("metadata")
    )
    store(events, base, scratch_dir(spark, "aside"), batch_id=batch)


def rows(spark, base):
    stored = read_class(spark, base, UID)
    return sorted(tuple(str(x) for x in r) for r in stored.select("metadata.uid", "time", "batch_id", "event_date").collect())


def files(spark, base):
    return Folder(spark, f"{base}/{class_path(UID)}")


def test_same_rows_before_during_and_after(spark):
    base = scratch_dir(spark, "store")
    for batch in range(5):
        write(spark, base, batch, 3)
    before = rows(spark, base)
    seen = []
    assert compact(spark, base, UID, before_commit=lambda: seen.append(rows(spark, base))) == 1
    assert seen == [before] and rows(spark, base) == before and len(before) == 30
    folder = files(spark, base)
    plain, packed = folder.live_paths(folder.snapshot())
    assert plain == [] and len(packed) == 3  # one file for each date
    assert read_class(spark, base, UID).where("event_date = '2023-11-14'").count() == 10
    opened = read_class(spark, base, UID)
    assert expire(spark, base, UID, grace_seconds=3600) == 0 and opened.count() == 30
    assert expire(spark, base, UID, grace_seconds=0) == 15 and rows(spark, base) == before
    assert compact(spark, base, UID) is None  # nothing to gain


def test_crash_replay_and_new_batches(spark):
    base = scratch_dir(spark, "store")
    for batch in range(3):
        write(spark, base, batch, 2)

    def crash():
        raise RuntimeError("lost")

    before = rows(spark, base)
    with pytest.raises(RuntimeError):
        compact(spark, base, UID, before_commit=crash)
    assert rows(spark, base) == before  # the packed files of the crash are nobody's
    assert compact(spark, base, UID, settled=lambda batch: int(batch) < 2) == 2
    assert rows(spark, base) == before
    write(spark, base, 1, 2)  # a replay of a covered batch
    write(spark, base, 2, 2)  # and of one that is still open
    assert rows(spark, base) == before
    write(spark, base, 3, 2)
    after = rows(spark, base)
    assert len(after) == 24
    assert compact(spark, base, UID) == 3 and rows(spark, base) == after
    assert expire(spark, base, UID, 0) > 0 and rows(spark, base) == after
    folder = files(spark, base)
    assert len(folder.files("_packed/version=*/event_date=*/*.parquet")) == 2 and folder.files("batch_id=*/event_date=*/*.parquet") == []
    assert folder.versions("_manifest") == [2, 3]


def test_appended_files_and_large_ones(spark):
    """The appended batch may grow after it was packed; files of half the target stay in place."""
    base = scratch_dir(spark, "store")
    for start in (0, 100):
        write(spark, base, None, 1, start=start)
    write(spark, base, 7, 1, rows=3000, start=1000)
    large = max(f.bytes for f in files(spark, base).files("batch_id=*/event_date=*/*.parquet"))
    before = rows(spark, base)
    assert compact(spark, base, UID, target=large * 2 - 1) == 1
    assert rows(spark, base) == before
    write(spark, base, None, 1, start=200)
    assert len(rows(spark, base)) == len(before) + 6
    folder = files(spark, base)
    snapshot = folder.snapshot()
    assert {f.folder.split("/")[0] for f in snapshot.live} == {"batch_id=7", "_packed"} and len(folder.open_files(snapshot)) == 1
    expire(spark, base, UID, 0)
    assert len(rows(spark, base)) == len(before) + 6


def test_nothing_stored(spark):
    base = scratch_dir(spark, "store")
    assert compact(spark, base, FINDING_CLASS_UID) is None and expire(spark, base, FINDING_CLASS_UID, 0) == 0
    assert read_class(spark, base, FINDING_CLASS_UID).count() == 0


def test_bins():
    rng = random.Random(2)
    some = [StoredFile("batch_id=1/event_date=x", f"f{i}", rng.randrange(1, 60)) for i in range(200)]
    bins = pack(some, 100)
    assert sorted(f for b in bins for f in b) == sorted(some)
    sizes = [sum(f.bytes for f in b) for b in bins]
    assert max(sizes) <= 100 and len(bins) <= 2 * sum(sizes) / 100
