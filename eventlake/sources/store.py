"""Read stored classes back: whole trees, single files, and views for SQL."""

from __future__ import annotations

import posixpath
import re
from functools import reduce
from urllib.parse import urlsplit, urlunsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.sources.manifest import PACKED, Folder
from eventlake.model import CATEGORIES, CLASS_SCHEMAS, FINDING_CLASS_UID, FINDING_SCHEMA, PARTITIONS, category_of, class_path


Schemas = dict[int, T.StructType]


def _schema(class_uid: int, schemas: Schemas | None) -> T.StructType:
    return ({FINDING_CLASS_UID: FINDING_SCHEMA} | (CLASS_SCHEMAS if schemas is None else schemas))[class_uid]


def read_tree(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files below a folder, at any depth."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def _read_paths(spark: SparkSession, root: str, schema: T.StructType, paths: list[str], name: str | None = None) -> DataFrame:
    """Rows of files or folders below one kind of place, with `batch_id` and `event_date`; `name` adds the file's name."""
    top = f"{root}/{PACKED}" if paths[0].startswith(f"{root}/{PACKED}/") else root
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", top).parquet(*paths)
    return rows.select(*schema.names, *([F.col("_metadata.file_name").alias(name)] if name else []))


def read_files(spark: SparkSession, root: str, class_uid: int, files: list[str], schemas: Schemas | None = None, name: str | None = None) -> DataFrame:
    """Some files of a class, named relative to its folder `root`."""
    schema = T.StructType([*_schema(class_uid, schemas).fields, *PARTITIONS.fields])
    packed = [f"{root}/{f}" for f in files if f.startswith(PACKED)]
    plain = [f"{root}/{f}" for f in files if not f.startswith(PACKED)]
    return reduce(DataFrame.unionByName, [_read_paths(spark, root, schema, paths, name) for paths in (plain, packed) if paths])


def read_class(spark: SparkSession, base: str, class_uid: int, schemas: Schemas | None = None) -> DataFrame:
    """One stored class with its partition columns; a class never written is an empty table, not an error.

    A condition on `event_date` leaves out the folders of all other dates. Where the class was compacted, the
    files are those that its newest snapshot lists, and the batches written since.
    """
    schema = T.StructType([*_schema(class_uid, schemas).fields, *PARTITIONS.fields])
    path = f"{base}/{class_path(class_uid)}"
    folder = Folder(spark, path)
    snapshot = folder.snapshot()
    if snapshot is not None:
        parts = [_read_paths(spark, path, schema, paths) for paths in folder.live_paths(snapshot) if paths]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("basePath", path).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def confined(base: str, name: str) -> str:
    """Path of a file named relative to the store; a name that leaves the store is refused."""
    place = urlsplit(base)
    root = posixpath.normpath(place.path or "/")
    path = posixpath.normpath(posixpath.join(root, name.strip()))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name!r} is outside the store")
    return urlunsplit((place.scheme, place.netloc, path, "", "")) if place.scheme else path


def read_findings(spark: SparkSession, base: str | None, file: str | None = None) -> DataFrame:
    """Stored findings, of one file when a non-blank name is given. No store gives an empty table."""
    if not base:
        return spark.createDataFrame([], FINDING_SCHEMA)
    if file and file.strip():
        return spark.read.schema(FINDING_SCHEMA).parquet(confined(base, file))
    return read_class(spark, base, FINDING_CLASS_UID)


def file_column(base: str) -> Column:
    """File of each row, relative to the store; unchanged when it lies elsewhere."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(decoded, "^file:/+", "/")
    root = re.sub("^file:/+", "/", base.rstrip("/"))
    return F.regexp_replace(path, "^" + re.escape(root + "/"), "")


def register_views(spark: SparkSession, base: str, schemas: Schemas | None = None) -> list[str]:
    """Temp views: category_class per stored class, category_all per category, and all_events.

    `schemas` are the stored classes, with those of the user's own.
    """
    classes = [*dict.fromkeys([*(CLASS_SCHEMAS if schemas is None else schemas), FINDING_CLASS_UID])]
    frames = {uid: read_class(spark, base, uid, schemas) for uid in classes}
    names = []

    def add(name: str, parts: list[DataFrame]) -> None:
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).createOrReplaceTempView(name)
        names.append(name)

    for uid in classes:
        add(class_path(uid).replace("/", "_"), [frames[uid]])
    for _, category in CATEGORIES:
        parts = [frames[uid] for uid in classes if category_of(uid) == category]
        if parts:
            add(f"{category}_all", parts)
    add("all_events", list(frames.values()))
    return names
