import pytest
from pyspark.sql import functions as F

from eventlake.model import FINDING_SCHEMA, category_of, class_path
from eventlake.operators import route as route_module
from eventlake.operators.detect import detect
from eventlake.operators.route import export, route, store, store_batch, store_findings
from eventlake.plans.adhoc import as_json, run_sql
from eventlake.session import scratch_dir
from eventlake.sources import store as reader
from tests.test_rules import rule


def test_class_paths():
    assert class_path(6003) == "application/api_activity"
    assert class_path(3002) == "iam/authentication"
    assert class_path(2004) == "findings/detection_finding"
    assert class_path(201001) == "system/win/registry_key_activity"
    assert category_of(0) == "other"


@pytest.mark.parametrize(
    "uid,reason",
    [
        ("6003", None),
        ("3002", None),
        ("2004", None),
        ('"3002"', "no usable class_uid"),
        ("null", "no usable class_uid"),
        ("-1", "no usable class_uid"),
        ("3002.0", "no usable class_uid"),
        ("99999", "unknown class_uid"),
        ("4294970298", "unknown class_uid"),
        ("4001", "no schema for class"),
    ],
)
def test_route(events, uid, reason):
    assert route(events('{"class_uid":%s}' % uid)).first().reject_reason == reason


DOCS = [
    '{"class_uid":6003,"time":1700000000000,"actor":{"app_name":"t"}}',
    '{"class_uid":6003,"actor":null}',
    '{"class_uid":3002,"src_endpoint":{"ip":"1.2.3.4","port":"x"},"time":"1700000000001"}',
    '{"class_uid":99999}',
    '{"class_uid":2004}',
    "7",
]


@pytest.mark.parametrize("staged", [True, False])
def test_store(spark, events, staged):
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    stored = store_batch(events(*DOCS), base, aside) if staged else store(events(*DOCS), base, aside)
    assert stored == {6003: 1, 3002: 1, 2004: 1}
    assert reader.read_findings(spark, base).select("class_uid", "rule_id").collect() == [(2004, None)]
    row = reader.read_class(spark, base, 3002).first()
    assert row.src_endpoint.ip == "1.2.3.4" and row.src_endpoint.port is None
    assert row.metadata is not None and row.metadata.uid is None
    bad = {r.event_id: r.reject_reason for r in reader.read_tree(spark, aside).collect()}
    assert bad == {
        "1": "expected object for 'actor'",
        "3": "unknown class_uid",
        "5": "no usable class_uid",
    }
    assert reader.read_class(spark, base, 1007).count() == 0


def test_replayed_batch_replaces_itself(spark, events):
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    for _ in range(2):
        store(events(*DOCS), base, aside, batch_id=0)
    store(events(*DOCS), base, aside, batch_id=1)
    assert reader.read_class(spark, base, 6003).count() == 2
    assert reader.read_tree(spark, aside).count() == 6
    assert reader.read_findings(spark, base).count() == 2


def test_files(spark, events):
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    store(events(*DOCS), base, aside)
    name = reader.read_class(spark, base, 6003).select(reader.file_column(base).alias("f")).first().f
    assert name.startswith("application/api_activity/batch_id=all/event_date=")
    assert reader.confined(base, " " + name + " ") == f"{base}/{name}"
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            reader.confined(base, bad)


def test_findings_reads(spark):
    base = scratch_dir(spark, "b")
    assert reader.read_findings(spark, None).schema == FINDING_SCHEMA
    assert reader.read_findings(spark, base).count() == 0
    row = spark.range(3).select(
        F.lit(2004).alias("class_uid"),
        F.timestamp_seconds("id").alias("time"),
        F.lit("high").alias("severity"),
        F.lit("r").alias("rule_id"),
        F.lit(None).cast("string").alias("observables"),
        F.struct(F.lit("u").alias("uid"), F.lit("t").alias("title")).alias("finding_info"),
        F.lit(None).cast(FINDING_SCHEMA["metadata"].dataType).alias("metadata"),
    )
    store_findings(row, base)
    stored = reader.read_findings(spark, base)
    assert stored.count() == 3
    file = stored.select(reader.file_column(base).alias("f")).first().f
    assert 0 < reader.read_findings(spark, base, file).count() <= 3
    store_findings(row.where("false"), base)
    assert reader.read_findings(spark, base).count() == 3
    assert export(stored, "alerts").count() == 3
    with pytest.raises(ValueError):
        export(stored, "some")


def test_views_and_sql(spark, events):
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    store(events(*DOCS), base, aside)
    names = reader.register_views(spark, base)
    assert {"application_api_activity", "application_all", "all_events"} <= set(names)
    assert run_sql(spark, "SELECT * FROM all_events;").count() == 3
    assert run_sql(spark, "SELECT id FROM range(50)").count() == 10
    assert run_sql(spark, "SELECT id FROM range(50) LIMIT 20 ; ").count() == 20
    assert run_sql(spark, "SELECT 'limit' AS x FROM range(50)").count() == 10
    assert run_sql(spark, "WITH a AS (SELECT * FROM range(50) LIMIT 40) SELECT * FROM a", 15).count() == 15
    assert run_sql(spark, "WITH a AS (SELECT * FROM range(50)) SELECT * FROM a LIMIT 12").count() == 12
    assert as_json(spark.sql("SELECT 1 AS a, NULL AS b")).first().json == '{"a":1,"b":null}'


def test_sorted_and_pruned(spark, events):
    """Stored files carry time statistics that a time range uses."""
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    store(events(*DOCS), base, aside)
    df = reader.read_class(spark, base, 6003).where("time > timestamp'2024-01-01'").select("class_uid")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(time" in plan and "ReadSchema: struct<class_uid:int,time:timestamp>" in plan


def test_a_time_range_reads_only_its_dates(spark, events):
    from eventlake.operators.triage import get_alerts, recent_events

    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    docs = ['{"class_uid":2004,"time":%d}' % (1700000000000 + day * 86_400_000) for day in range(20)]
    store_batch(events(*docs, '{"class_uid":2004}'), base, aside)
    found = reader.read_findings(spark, base)
    some = get_alerts(found, "2023-11-16T00:00:00Z", "2023-11-18T23:00:00Z", limit=None)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and some.count() == 3
    assert len(found.where("event_date = DATE'2023-11-16'").inputFiles()) >= 1 and found.count() == 21
    assert "PartitionFilters: [isnotnull(event_date" in recent_events(found)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_date_are_written_by_tasks_of_bounded_size(spark, monkeypatch):
    """Findings of one date and events without one, more than a task should sort."""
    monkeypatch.setattr(route_module, "WRITE_BYTES", 64 << 10, raising=False)
    base, aside = scratch_dir(spark, "b"), scratch_dir(spark, "q")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    text = "concat('{\"class_uid\":6003,\"k\":1,\"activity_name\":\"', sha2(string(id), 256), '\"}')"
    made = spark.range(0, 8000, 1, 8).selectExpr("sha2(string(id), 256) AS event_id", f"parse_json({text}) AS data", "cast(map() AS map<string,variant>) AS metadata")
    store_batch(made, base, aside)
    store_findings(detect(made, [rule(sel={"k": 1})]), base)
    for stored in (reader.read_class(spark, base, 6003), reader.read_findings(spark, base)):
        files = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
        assert sum(files) == 8000 and max(files) < 6000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == size
