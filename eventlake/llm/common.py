"""Shared helpers: settings, scratch tables, ranks without a single task, broadcast behind a size check."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.session import scratch_dir

# A table this small (rows of a few longs and short strings, some tens of MB) may be sent to every executor.
BROADCAST_ROWS = 200_000
# Shuffle files are deleted at the end of a query, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settings(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded size, splitting of skewed joins, and this package on the workers' path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each Spark context, as `--py-files` would."""
    context = spark.sparkContext
    if getattr(context, "_eventlake_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="eventlake-code-")) / "eventlake.zip"  # served by the driver
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._eventlake_sent = True


def stored(df: DataFrame, label: str, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors.

    The write's own shuffle files go as soon as it ends; nothing reads them again.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        writer.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a `stored` table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table when its counted rows stay below the limit; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= limit else df


def select_only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under inner names, so that extra columns of the input can't clash."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in columns.items()])


def sheltered(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with every column but the needed ones under a name that no operator uses, and the names: outer to inner."""
    names = {c: c if c in needed else f"__extra{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str], *added: str) -> DataFrame:
    """The columns of the input under their own names, and those an operator adds, which replace equal ones."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], *added)


def ranked(df: DataFrame, order: list[str], by: list[str], name: str, label: str) -> DataFrame:
    """Number the rows 0, 1, … by `order` within each group `by`, without one task per group.

    Rows are range-partitioned by (by, order), numbered inside each range, and shifted by the rows
    that the group has in earlier ranges. The table of shifts has at most a row for each range and
    group that crosses it. A group may hold all rows.
    """
    keys = [*by, *order]
    part = Window.partitionBy("__range", *by)
    inside = stored(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .withColumn("__range", F.spark_partition_id())
        .withColumn("__row", F.row_number().over(part.orderBy(*[F.col(k).asc_nulls_first() for k in order])) - 1),
        label,
    )
    sizes = inside.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if by else (
        Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    crossing = shifts.where("__before > 0")
    on = F.lit(True)
    left, right = inside.alias("l"), crossing.alias("r")
    for key in ["__range", *by]:
        on = on & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.join(right, on, "left").select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        (F.col("l.__row") + F.coalesce(F.col("r.__before"), F.lit(0))).cast("long").alias(name),
    )
