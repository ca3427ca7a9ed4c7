"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings every job of this package relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # States of streams grow with their keys: on disk, with changes shipped to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # The JVM does not compile methods above 8000 bytes: beyond that, split code beats fused code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, **extra: str) -> SparkSession:
    """Session for tests and benches on one machine; on a cluster use spark-submit and `configure`."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("EVENTLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context, as `--py-files` would."""
    context = spark.sparkContext
    if getattr(context, "_eventlake_sent", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="eventlake-code-")) / "eventlake.zip"  # served by the driver
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._eventlake_sent = True


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for a written table, shared by all executors.

    It lies under ``spark.checkpoint.dir``. Only a local master may do without that setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/eventlake-{label}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"eventlake-{label}-") + "/t"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies; a missing one is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
