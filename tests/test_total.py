"""No event is lost and none stops the job: extreme numbers, equal lines, odd times, odd paths, odd SQL."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.operators.coerce import coerce
from eventlake.operators.detect import check_regexes, detect, match_rules, prepare_table
from eventlake.operators.route import store_batch
from eventlake.operators.rules import RuleError, merge_rules, rule_from_dict, rule_table
from eventlake.operators.triage import get_alerts
from eventlake.plans.adhoc import run_sql
from eventlake.session import scratch_dir
from eventlake.sources import store as reader
from eventlake.sources.landing import number_repeats, read_ndjson

TIMES = ["-9223372036854775808", "9223372036854775807", '"1700000000000"', '"x"', "null", "1700000000000", "9100000000000000"]


def rule(**selection):
    return rule_from_dict({"id": "r", "title": "r", "detection": {"s": selection, "condition": "s"}})


def test_every_event_has_a_finding_with_the_time_it_is_stored_with(spark, events):
    docs = ['{"class_uid":3002,"a":1,"time":%s}' % t for t in TIMES]
    micros = F.unix_micros("time")  # Python has no years beyond 9999
    found = {f.metadata.uid: f.us for f in detect(events(*docs), [rule(a=1)]).select("metadata", micros.alias("us")).collect()}
    assert len(found) == len(TIMES) and all(found.values())
    schema = T.StructType([T.StructField("time", T.TimestampType())])
    stored = {r.event_id: r.us for r in coerce(events(*docs), schema).select("event_id", F.unix_micros("row.time").alias("us")).collect()}
    assert all(stored[k] is None or stored[k] == found[k] for k in found)
    assert stored["2"] == stored["5"] is not None and stored["0"] is None


def test_stored_and_refused_add_up_and_nothing_is_left_behind(spark, events):
    docs = ['{"class_uid":%s,"time":%s}' % (c, t) for c in ("3002", "2004", "-9223372036854775808", "1e300") for t in TIMES]
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = {f for f in os.listdir(shared) if "-stage-" in f}
    stored = store_batch(events(*docs), base, aside)
    assert sum(stored.values()) + reader.read_tree(spark, aside).count() == len(docs)
    assert {f for f in os.listdir(shared) if "-stage-" in f} == before


def test_equal_lines_have_their_own_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":1}\n{"x":1}\n{"x":2}\nno json\n{"x":1}\n')
    (tmp_path / "b.json").write_text('{"x":1}\n')
    ids = lambda: sorted(r.event_id for r in read_ndjson(spark, str(tmp_path)).collect())
    assert len(set(ids())) == 6 and ids() == ids()


def test_repeats_of_a_line_are_spread_over_tasks(spark):
    """A count of repeats is one small row; the rows made of it are not one task's work."""
    lines = spark.range(20_000).selectExpr("IF(id < 19990, 'hot', concat('v', id % 5)) AS value", "'f' AS file")
    numbered = number_repeats(lines)
    tasks = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 20_000 and max(tasks) < 10_000
    want = {("hot", i) for i in range(1, 19_991)} | {(f"v{i}", n) for i in range(5) for n in (1, 2)}
    rows = numbered.collect()
    assert len(rows) == 20_000 and {(r["value"], int((r["file"] + "#1").split("#")[1])) for r in rows} == want


@pytest.mark.parametrize("value,hit", [("NaN", False), ("7d", False), ("Infinity", False), (" 7 ", True), ("7.5e0", True), ("1e400", True)])
def test_only_numbers_compare(spark, events, value, hit):
    assert (detect(events('{"n":"%s"}' % value), [rule(**{"n|gt": 5})]).count() == 1) is hit
    assert (detect(events('{"n":["%s"]}' % value), [rule(**{"n|gt": 5})]).count() == 1) is hit


def test_nan_in_a_number_column_is_no_number(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 6.0), (3, None)], "id int, n double")
    assert [r.id for r in match_rules(prepare_table(df), [rule(**{"n|gt": 5})], keep=["id"]).collect()] == [2]


def test_all_alerts_without_a_limit(spark, events):
    found = detect(events(*['{"a":1,"time":1700000000000}'] * 12), [rule(a=1)])
    span = ("2023-01-01T00:00:00Z", "2024-01-01T00:00:00Z")
    assert get_alerts(found, *span, limit=None).count() == 12 and get_alerts(found, *span).count() == 10


def test_new_rules_with_one_id(spark):
    made = [rule_from_dict({"id": i, "title": t, "detection": {"s": {"a": 1}, "condition": "s"}}) for i, t in (("a", "1"), ("b", "2"), ("b", "1"))]
    merged, conflicts = merge_rules(rule_table(spark, made[:1]), rule_table(spark, made))
    assert sorted((r.id, r.title) for r in merged.collect()) == [("a", "1"), ("b", "1")]
    assert sorted((r.id, r.title) for r in conflicts.collect()) == [("a", "1"), ("b", "2")]
    nameless = rule_table(spark, made[1:2]).withColumn("id", F.lit(None).cast("string"))
    merged, conflicts = merge_rules(rule_table(spark, made[:1]), nameless)
    assert (merged.count(), conflicts.count()) == (1, 1)


def test_bad_pattern_is_named(spark):
    check_regexes(spark, ["a+", "b"])
    with pytest.raises(RuleError, match="\\(x"):
        check_regexes(spark, ["a+", "(x", "b"])


def test_names_inside_the_store_only():
    assert reader.confined("s3a://bucket/lake", "a/b.parquet") == "s3a://bucket/lake/a/b.parquet"
    assert reader.confined("/lake", "a") == "/lake/a" and reader.confined("hdfs://n:8020/", "a") == "hdfs://n:8020/a"
    for base in ("s3a://bucket/lake", "/lake"):
        with pytest.raises(ValueError):
            reader.confined(base, "../other/x")


def test_file_column_of_a_path_with_blanks(spark, tmp_path):
    base = tmp_path / "my lake+1"
    spark.range(1).write.parquet(str(base / "part"))
    df = reader.read_tree(spark, str(base))
    assert df.select(reader.file_column(str(base)).alias("f")).first().f.startswith("part/part-")


def test_user_sql_reads_views_only(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.range(3).createOrReplaceTempView("some_view")
    with pytest.raises(Exception):
        run_sql(spark, f"SELECT * FROM parquet.`{tmp_path}/t`").collect()
    for text in ("DROP VIEW some_view", "SET spark.sql.ansi.enabled=false", "CREATE VIEW v AS SELECT 1", "SHOW TABLES"):
        with pytest.raises(ValueError):
            run_sql(spark, text)
    assert run_sql(spark, "WITH a AS (SELECT * FROM some_view) SELECT count(*) AS n FROM a").first().n == 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
