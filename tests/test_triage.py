from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from eventlake.functions.prune import prune_json
from eventlake.model import FINDING_SCHEMA
from eventlake.operators.triage import (
    action_payloads,
    count_by_severity,
    fetch_alert,
    filter_alerts,
    get_alerts,
    parse_time,
    recent_events,
    severity_facets,
    severity_rank,
)

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def finding(n, time, severity="high", uid=None, title="T"):
    uid = uid or f"e{n}"
    return (2004, time, severity, "r", None, (f"f{n:03}", title), (uid, uid, None))


def findings(spark, *rows):
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def test_alert_range_and_page(spark):
    df = findings(spark, *[finding(n, T0 + timedelta(minutes=n)) for n in range(14)])
    got = get_alerts(df, "2024-01-01T00:01:00Z", "2024-01-01T02:12:00+02:00").collect()
    assert [r.uid for r in got] == [f"e{n}" for n in range(12, 2, -1)]
    both_ends = get_alerts(df, "2024-01-01T00:01:00Z", "2024-01-01T00:02:00Z").collect()
    assert [r.uid for r in both_ends] == ["e2", "e1"]


def test_alert_defaults(spark):
    now = datetime.now(timezone.utc)
    df = findings(spark, finding(1, now - timedelta(hours=23)), finding(2, now - timedelta(hours=25)))
    assert [r.uid for r in get_alerts(df).collect()] == ["e1"]
    assert [r.uid for r in get_alerts(df, "nonsense").collect()] == ["e1"]
    assert parse_time("2024-01-01T00:00:00", T0 + timedelta(1)) == T0 + timedelta(1)
    assert recent_events(df.select("time", "class_uid")).count() == 1


def test_top_k_needs_no_full_sort(spark):
    plan = get_alerts(findings(spark, finding(1, T0)))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_fetch(spark):
    df = findings(spark, finding(2, T0, uid="x"), finding(1, T0, uid="x", title=None))
    got = fetch_alert(df, "x").collect()
    assert len(got) == 1 and '"uid":"f001"' in got[0].alert
    assert "observables" not in got[0].alert and "title" not in got[0].alert and "product" not in got[0].alert
    assert fetch_alert(df, "y").count() == 0


def test_prune(spark):
    row = spark.sql(
        """SELECT named_struct('a', cast(null AS string), 'b', named_struct('c', cast(null AS int)), 'e', cast(array() AS array<int>),
           'f', array(cast(null AS string)), 'g', array(named_struct('z', cast(null AS int))), 'h', 1,
           'm', map('k', cast(null AS int), 'l', 2), 'n', map('k', cast(null AS int)),
           'o', array(array(cast(null AS int)), cast(array() AS array<int>))) AS r"""
    )
    text = row.select(prune_json(F.col("r"), row.schema["r"].dataType)).first()[0]
    assert text == '{"f":[null],"g":[{}],"h":1,"m":{"l":2},"o":[[null],[]]}'
    empty = spark.sql("SELECT named_struct('a', cast(null AS string)) AS r")
    assert empty.select(prune_json(F.col("r"), empty.schema["r"].dataType)).first()[0] == "{}"


def test_filter_and_facets(spark):
    rows = [("e1", "Alpha", "high"), ("e2", "beta", ""), ("e3", None, None), ("x4", "Alp", "low")]
    df = spark.createDataFrame(rows, "uid string, title string, severity string")
    ids = lambda d: sorted(r.uid for r in d.collect())
    assert ids(filter_alerts(df, ["high"])) == ["e1", "e2", "e3"]
    assert ids(filter_alerts(df, None, "ALP")) == ["e1", "x4"]
    assert ids(filter_alerts(df, ["low"], "E")) == ["e2", "e3"]
    assert [r.severity for r in severity_facets(df).collect()] == ["high", "low"]
    ranks = df.select(severity_rank(F.col("severity")).alias("r")).collect()
    assert [r.r for r in ranks] == [1, 5, 5, 3]


def test_counts(spark):
    df = findings(spark, finding(1, T0), finding(2, T0), finding(3, T0, "low"))
    assert [tuple(r) for r in count_by_severity(df).collect()] == [("high", 2), ("low", 1)]


def test_actions(spark):
    df = findings(spark, finding(2, T0, uid="x"), finding(1, T0, uid="x"), finding(3, T0))
    req = spark.createDataFrame(
        [(1, "x", None), (2, "x", "given"), (3, None, "d"), (4, "none", "d")],
        "request_id int, alert_id string, data string",
    )
    got = {r.request_id: r for r in action_payloads(req, df).collect()}
    assert '"uid":"f001"' in got[1].data and got[1].error is None
    assert got[2].data == "given"
    assert (got[3].error, got[3].data) == ("missing alert_id", None)
    assert (got[4].error, got[4].data) == ("no such alert", None)
