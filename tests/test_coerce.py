from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.operators.coerce import accepted_rows, coerce

SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("l", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("s", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("st", T.StructType([T.StructField("a", T.StringType())])),
        T.StructField("ar", T.ArrayType(T.IntegerType())),
        T.StructField("req", T.StringType(), False),
    ]
)
REJECT = object()
INSTANT = datetime(2023, 11, 14, 22, 13, 20)

CASES = [
    ('"i":1', "i", 1),
    ('"i":99999999999', "i", None),
    ('"i":1.0', "i", None),
    ('"i":"1"', "i", None),
    ('"i":null', "i", None),
    ('"l":5', "l", 5),
    ('"l":"7"', "l", None),
    ('"l":1.5', "l", None),
    ('"l":99999999999999999999', "l", None),
    ('"d":1', "d", 1.0),
    ('"d":1.5', "d", 1.5),
    ('"d":"1.5"', "d", None),
    ('"b":true', "b", True),
    ('"b":"true"', "b", None),
    ('"b":1', "b", None),
    ('"s":"x"', "s", "x"),
    ('"s":7', "s", "7"),
    ('"s":true', "s", "true"),
    ('"s":{"k":[1]}', "s", '{"k":[1]}'),
    ('"s":null', "s", None),
    ('"ts":1700000000000', "ts", INSTANT),
    ('"ts":"1700000000000"', "ts", INSTANT),
    ('"ts":" 17 "', "ts", None),
    ('"ts":"2024-01-01T00:00:00Z"', "ts", None),
    ('"ts":99999999999999999', "ts", None),
    ('"st":{"a":"q","zz":1}', "st", ("q",)),
    ('"zz":1', "st", (None,)),
    ('"st":{}', "st", (None,)),
    ('"st":null', "st", REJECT),
    ('"st":"x"', "st", REJECT),
    ('"ar":[1,2]', "ar", [1, 2]),
    ('"ar":[]', "ar", []),
    ('"zz":1', "ar", None),
    ('"ar":["x",4]', "ar", [None, 4]),
    ('"ar":null', "ar", REJECT),
    ('"ar":"x"', "ar", REJECT),
    ('"i":1,"i":2', "i", 2),
]


@pytest.fixture(scope="module")
def coerced(spark):
    rows = [(n, "{" + fragment + ',"req":"x"}') for n, (fragment, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, t string").select("n", F.parse_json("t").alias("data"))
    return {r.n: r for r in coerce(df, SCHEMA).drop("data").collect()}


@pytest.mark.parametrize("n", range(len(CASES)), ids=[c[0] + "->" + c[1] for c in CASES])
def test_table(coerced, n):
    fragment, member, expected = CASES[n]
    row = coerced[n]
    if expected is REJECT:
        assert row.reject_reason
        return
    assert row.reject_reason is None
    value = row.row[member]
    assert (tuple(value) if isinstance(value, tuple) else value) == expected


@pytest.mark.parametrize("text", ['{"i":1}', '{"req":null}', "[1]", "7", "null"])
def test_whole_row_rejects(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("data"))
    out = coerce(df, SCHEMA)
    assert out.first().reject_reason
    assert accepted_rows(out).count() == 0


def test_roundtrip(spark, tmp_path):
    port = T.StructType([T.StructField("number", T.LongType()), T.StructField("open", T.BooleanType())])
    schema = T.StructType(
        [
            T.StructField("host", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("load", T.DoubleType()),
            T.StructField("ports", T.ArrayType(port)),
        ]
    )
    text = '{"host":{"name":"tape-7"},"load":0.5,"ports":[{"number":22,"open":true},{"number":8080,"open":false}]}'
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("data"))
    accepted_rows(coerce(df, schema)).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.select(F.to_json(F.struct("*"))).first()[0] == text


def test_unsupported_type(spark):
    schema = T.StructType([T.StructField("m", T.DateType())])
    rows = [('{"m":"2024-01-01"}',), ("{}",)]
    df = spark.createDataFrame(rows, "t string").select(F.parse_json("t").alias("data"))
    reasons = [r.reject_reason for r in coerce(df, schema).collect()]
    assert reasons[0] and reasons[1] is None


def test_each_member_is_read_once(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(F.parse_json("t").alias("data"))
    plan = accepted_rows(coerce(df, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('$["i"]') == 1
    assert "Filter" not in plan
