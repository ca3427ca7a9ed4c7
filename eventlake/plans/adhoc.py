"""Ad-hoc SQL over the registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT = 10


def _has_limit(spark: SparkSession, sql: str) -> bool:
    """Whether the outermost node of the analysed plan is a limit."""
    plan = spark.sql("EXPLAIN EXTENDED " + sql).first()[0]
    lines = plan.split("== Analyzed Logical Plan ==\n", 1)[1].split("\n==", 1)[0].split("\n")[1:]
    root = lines[0]
    if root.startswith("WithCTE"):  # the query proper is the last child
        root = next(line[3:] for line in lines[1:] if line.startswith("+- "))
    return root.startswith("GlobalLimit")


def _is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the text is a query; commands would run as soon as they are analysed."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kinds = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    return not any(loader.loadClass(kind).isInstance(plan) for kind in kinds)


def run_sql(spark: SparkSession, sql: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Run a query over the registered views; without a limit of its own it gets `limit` rows.

    Commands are refused, and a path can't stand for a table.
    """
    text = sql.strip().rstrip(";").rstrip()
    if not _is_query(spark, text):
        raise ValueError("only queries can be run")
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        df = spark.sql(text)
        return df if _has_limit(spark, text) else df.limit(limit)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
