"""Sessions: runs of hits of a group with no pause longer than a gap, in batch and over streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_SECONDS = 3600


def sessions(hits: DataFrame, group: list[str], gap_seconds: int, time: str = "time", part_seconds: int = PART_SECONDS) -> DataFrame:
    """Sessions of a table of hits: group columns, start and end (times of the first and last hit), n.

    Hits are laid out by (group, hour). Within an hour they form pieces; only an hour's first piece can
    go on from hours before, and whether it does follows from one row for each hour of the group. So a hot
    group spreads over many tasks, also when its session never ends. A pause of exactly the gap does not
    end a session; hits without a time belong to none.
    """
    gap = gap_seconds * 1_000_000
    known = hits.select(*group, F.unix_micros(F.col(time).cast("timestamp")).alias("__us")).where("__us IS NOT NULL")
    merged = known.groupBy(*group, "__us").agg(F.count(F.lit(1)).alias("__n"))  # equal instants, before the shuffle
    keys = [*group, "__part"]
    cut = merged.withColumn("__part", F.floor(F.col("__us") / (part_seconds * 1_000_000))).repartition(*keys)
    inside = Window.partitionBy(*keys).orderBy("__us")
    fresh = F.coalesce(F.col("__us") - F.lag("__us").over(inside) > gap, F.lit(False)).cast("int")
    numbered = cut.withColumn("__new", fresh).withColumn("__piece", F.sum("__new").over(inside))
    pieces = numbered.groupBy(*keys, "__piece").agg(F.min("__us").alias("__from"), F.max("__us").alias("__to"), F.sum("__n").alias("__n"))

    parts = pieces.groupBy(*keys).agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"), F.max("__from").alias("__last"), F.max("__piece").alias("__pieces"))
    before = Window.partitionBy(*group).orderBy("__part")
    goes_on = F.coalesce(F.col("__from") - F.lag("__to").over(before) <= gap, F.lit(False))
    linked = parts.withColumn("__goes_on", goes_on)
    # Start of the session that is open at the end of an hour, where the hour itself tells.
    own = F.when(F.col("__pieces") > 0, F.col("__last")).when(~F.col("__goes_on"), F.col("__from"))
    linked = linked.withColumn("__own", own)
    carried = F.last("__own", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    begun = linked.withColumn("__start", carried).where("__goes_on").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start")

    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = pieces.join(begun, reduce(lambda x, y: x & y, same) & (F.col("__piece") == 0), "left")
    whole = joined.groupBy(*group, F.coalesce("__start", "__from").alias("__begin")).agg(F.max("__to").alias("__end"), F.sum("__n").alias("n"))
    return whole.select(*group, F.timestamp_micros("__begin").alias("start"), F.timestamp_micros("__end").alias("end"), "n")


def stream_sessions(
    hits: DataFrame, group: list[str], gap_seconds: int, delay: str, time: str = "time", before: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """The same sessions over a stream, each once the watermark has passed its end by the gap.

    `before` picks hits once they have moved the watermark.
    """
    marked = before(hits.withWatermark(time, delay))
    found = marked.groupBy(*group, F.session_window(time, f"{gap_seconds} seconds").alias("__s"))
    counted = found.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))
    return counted.select(*group, "start", "end", "n")
