import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlake.operators.correlate import KINDS, correlate, correlation_from_dict, span_seconds
from eventlake.operators.rules import RuleError
from eventlake.operators.timejoin import asof_join
from eventlake.streaming.correlation import correlate_new

T0 = datetime(2024, 1, 1)


def spec(kind, rules, span, **condition):
    body = {"type": kind, "rules": rules, "group-by": ["g"], "timespan": span, "condition": condition}
    return correlation_from_dict({"id": kind, "correlation": body})


@pytest.fixture(scope="module")
def rows():
    """One group holds three quarters of the hits; many hits share an instant."""
    rng = random.Random(3)
    return [
        (
            rng.choice(["r1", "r2", "r3"]),
            rng.choice(["a", "a", "a", None]),
            rng.choice(["x", "y", "z", None]),
            T0 + timedelta(seconds=rng.randrange(0, 2000)),
        )
        for _ in range(500)
    ]


@pytest.fixture(scope="module")
def hits(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, g string, v string, time timestamp")


def brute(rows, kind, rules, span):
    out = set()
    for rule_id, g, _, t in rows:
        if rule_id not in rules:
            continue
        seen = [r for r in rows if r[1] == g and r[0] in rules and timedelta(0) <= t - r[3] <= timedelta(seconds=span)]
        n = len(rules)
        if kind == "event_count":
            n = len(seen)
        elif kind == "value_count":
            n = len({r[2] for r in seen} - {None})
        elif kind == "temporal" and {r[0] for r in seen} != set(rules):
            continue
        elif kind == "temporal_ordered":

            def chain(i, upto):
                return i < 0 or any(r[0] == rules[i] and r[3] <= upto and chain(i - 1, r[3]) for r in seen)

            if rule_id != rules[-1] or not chain(len(rules) - 2, t):
                continue
        out.add((g, t, n))
    return out


@pytest.mark.parametrize("span", [7, 61])
@pytest.mark.parametrize("kind", KINDS)
def test_against_brute_force(hits, rows, kind, span):
    rules = ["r1", "r2"] if kind != "temporal_ordered" else ["r3", "r1", "r2"]
    got = correlate(hits, spec(kind, rules, f"{span}s", gte=0, field="v")).collect()
    assert {tuple(r) for r in got} == brute(rows, kind, rules, span)
    assert len(set(got)) == len(got)


def test_threshold(hits, rows):
    got = {tuple(r) for r in correlate(hits, spec("event_count", ["r1"], "1m", gt=2, lte=5)).collect()}
    assert got == {r for r in brute(rows, "event_count", ["r1"], 60) if 2 < r[2] <= 5}


@pytest.mark.parametrize("kind", KINDS)
def test_incremental_equals_batch(hits, rows, kind):
    rules = ["r1", "r2"]
    s = spec(kind, rules, "45s", gte=2, field="v")
    cut = T0 + timedelta(seconds=900)
    late = hits.where((hits.time >= cut) | ((hits.time >= T0 + timedelta(seconds=300)) & (hits.rule_id == "r1")))
    early = hits.exceptAll(late)
    latest = {}
    done = None
    for batch in (early, late):
        done = batch if done is None else done.unionAll(batch)
        for r in correlate_new(batch, lambda d=done: d, s).collect():
            latest[(r.g, r.time)] = r.n
    assert {(g, t, n) for (g, t), n in latest.items()} >= {tuple(r) for r in correlate(hits, s).collect()}


def test_windows_are_sliced(hits):
    """No window runs over a whole group: every one is partitioned by time slice as well."""
    for kind in KINDS:
        plan = correlate(hits, spec(kind, ["r1", "r2"], "10s", gte=1, field="v"))._jdf.queryExecution().optimizedPlan()
        for line in plan.toString().split("\n"):
            if line.lstrip(" :+-").startswith("Window"):
                assert "__slot" in line


def spread(spark, rows):
    """Rows of each partition, as the last shuffle left them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", KINDS)
def test_a_hot_group_within_one_timespan_spreads(spark, kind):
    n = 20_000
    hits = spark.range(n).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("rule_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.timestamp_micros(F.col("id") * 20_000_000).alias("time"), (F.col("id") % 7).alias("v"),
    )
    counts = kind in ("event_count", "value_count")
    met = correlate(hits, spec(kind, ["r0", "r1", "r2"], "1w", gte=1, field="v")).where("g = 'hot'")
    rows = spread(spark, met)
    assert sum(rows) > (n // 2 - 1 if counts else n // 7) and len(rows) >= 6 and max(rows) < sum(rows) // 2


@pytest.mark.parametrize("kind", ["temporal", "temporal_ordered"])
def test_twelve_rules_read_the_hits_as_often_as_two(hits, rows, kind):
    def plan(rules):
        return correlate(hits, spec(kind, rules, "1m"))._jdf.queryExecution().optimizedPlan().toString()

    few, many = plan(["r1", "r2"]), plan([f"r{i}" for i in range(1, 13)])
    assert many.count("LogicalRDD") == few.count("LogicalRDD") == 2 and many.count("Join") == few.count("Join") == 1
    wanted = ["r3", "r1", "r2", "r1", "r3", "r2"]
    got = correlate(hits, spec(kind, wanted, "40s")).collect()
    assert {tuple(r) for r in got} == {(g, t, 6) for g, t, _ in brute(rows, kind, wanted, 40)} and got


def test_documents():
    assert span_seconds("5m") == 300
    for bad in (
        {},
        {"correlation": {"type": "nope"}},
        {"correlation": {"type": "event_count", "timespan": "5m"}},
        {"correlation": {"type": "value_count", "timespan": "5m", "condition": {"gte": 1}}},
        {"correlation": {"type": "temporal", "timespan": "5 minutes"}},
        {"correlation": {"type": "event_count", "timespan": "5m", "condition": {"near": 1}}},
    ):
        with pytest.raises(RuleError):
            correlation_from_dict(bad)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("width", [50, 86_400])
def test_asof(spark, rows, inclusive, width):
    left = [(i, g, t) for i, (r, g, _, t) in enumerate(rows) if r == "r1"]
    right = [(g, t, i) for i, (r, g, _, t) in enumerate(rows) if r == "r2"]
    got = asof_join(
        spark.createDataFrame(left, "id int, g string, time timestamp"),
        spark.createDataFrame(right, "g string, time timestamp, n int"),
        ["g"], "time", ["n"], inclusive=inclusive, slice_seconds=width,
    ).collect()
    want = {}
    for i, g, t in left:
        fits = [(rt, n) for rg, rt, n in right if g is not None and rg == g and (rt < t or (inclusive and rt == t))]
        want[i] = max(fits) if fits else (None, None)
    assert {r.id: (r.right_time, r.n) for r in got} == want
    assert len(got) == len(left)


def test_asof_of_a_hot_key_spreads(spark):
    n = 20_000
    at = F.timestamp_micros(F.col("id") * 4_000_000)
    left = spark.range(n).select(F.lit("hot").alias("g"), at.alias("time"), "id")
    found = asof_join(left, left.select("g", "time", F.col("id").alias("n")), ["g"], "time", ["n"], inclusive=False)
    rows = spread(spark, found)
    assert len(rows) >= 6 and max(rows) < n // 2
    assert found.where("id > 0 AND (n IS NULL OR n <> id - 1)").isEmpty()
