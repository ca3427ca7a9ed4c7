"""Readers of landed records. The same function serves batch and streaming via `reader`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions.variants import get, json_or_text, variant_of
from eventlake.operators.envelope import EMPTY_METADATA, from_json_values, push_events, with_entries

# Repeats of a line up to which its count is turned into rows in place, and rows of a run beyond that.
FEW, RUN = 4, 1000


def _reader(spark: SparkSession, streaming: bool, max_files: int | None = None):
    if not streaming:
        return spark.read
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def read_text(
    spark: SparkSession,
    path: str,
    *,
    whole: bool = False,
    streaming: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """Landed text with its file: one row per line, or per file for `whole`."""
    reader = _reader(spark, streaming, max_files).option("recursiveFileLookup", "true")
    return reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"))


def number_repeats(lines: DataFrame) -> DataFrame:
    """Tell equal lines (file, value) apart: the second and later ones get their number behind the file.

    Equal lines are equal rows, so they are counted, in parts before the shuffle, and dealt out again: one
    reading, and no task that holds all repeats of a line. A count says nothing of the rows it stands for, so
    large ones are cut into runs, which go to a fixed number of tasks before rows are made of them.
    """
    counted = lines.groupBy("file", "value").agg(F.count(F.lit(1)).alias("__n"))
    few = counted.where(F.col("__n") <= FEW).select("file", "value", F.lit(1).cast("long").alias("__from"), F.col("__n").alias("__to"))
    many = counted.where(F.col("__n") > FEW).withColumn("__run", F.explode(F.expr(f"sequence(0L, (__n - 1) DIV {RUN})")))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = F.col("__run") * RUN
    runs = many.repartition(tasks, "file", "value", "__run").select("file", "value", (start + 1).alias("__from"), F.least(start + RUN, "__n").alias("__to"))
    each = few.union(runs).select("file", "value", F.explode(F.sequence("__from", "__to")).alias("__nth"))
    return each.select("value", F.when(F.col("__nth") > 1, F.concat("file", F.lit("#"), "__nth")).otherwise(F.col("file")).alias("file"))


def land_pushed(lines: DataFrame) -> DataFrame:
    """Landed rows of pushed records (value, file), equal lines of a file told apart.

    A micro-batch holds files as a whole, so a stream of `read_text` that lands its batches by this gives the
    same ids as `read_pushed` does in batch.
    """
    return push_events(number_repeats(lines), position=("file",))


def read_pushed(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Pushed record envelopes, one JSON text per line; see `push_events` for the layout."""
    lines = read_text(spark, path, streaming=streaming, max_files=max_files)
    if not streaming:
        lines = number_repeats(lines)
    return push_events(lines, position=("file",))


def read_ndjson(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One JSON value per line. Lines that are not JSON get a reject reason."""
    lines = read_text(spark, path, streaming=streaming).where(F.trim("value") != "")
    if not streaming:
        lines = number_repeats(lines)
    events = from_json_values(
        lines.withColumn("data", F.try_parse_json("value")).withColumn("meta", F.expr(EMPTY_METADATA)),
        F.struct("data", "value"),
        F.col("meta"),
        ids=[F.col("file"), F.col("value")],
    )
    return events.select(
        "event_id",
        F.col("data.data").alias("data"),
        "metadata",
        F.col("data.value").alias("raw"),
        F.when(F.col("data.data").isNull(), "malformed record").alias("reject_reason"),
    )


def read_http_bodies(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One request body per file: JSON when it parses, else the text itself."""
    bodies = read_text(spark, path, whole=True, streaming=streaming)
    return from_json_values(
        bodies, json_or_text(F.col("value")), ids=[F.col("file"), F.col("value")]
    )


def read_json_objects(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One JSON document per file, as object stores deliver cloud logs; unparsable files are rejected."""
    files = read_text(spark, path, whole=True, streaming=streaming)
    return from_json_values(
        files, F.try_parse_json("value"), ids=[F.col("file"), F.col("value")]
    ).withColumn("reject_reason", F.when(F.col("data").isNull(), "malformed record"))


def read_hec(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Landed HTTP-collector envelopes, one per line: `event` is the data, the rest metadata."""
    lines = read_text(spark, path, streaming=streaming).where(F.trim("value") != "")
    if not streaming:
        lines = number_repeats(lines)
    body = F.try_parse_json("value")
    rest = F.map_filter(
        F.try_variant_get(body, "$", "map<string,variant>"), lambda k, _: k != "event"
    )
    events = from_json_values(
        lines,
        get(body, "event"),
        with_entries(rest, source_type=variant_of(F.lit("splunk_hec"))),
        ids=[F.col("file"), F.col("value")],
    )
    return events.withColumn("reject_reason", F.when(F.col("data").isNull(), "no event member"))
