"""Sessions in batch and over a stream, against a walk over sorted hits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlake.operators.sessions import sessions, stream_sessions
from eventlake.plans.q_stream import run_out

T0 = datetime(2024, 1, 1)
SCHEMA = "g string, time timestamp"


def make(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), T0 + timedelta(seconds=rng.randrange(4000))) for _ in range(250)]
    return rows + [("c", T0 + timedelta(seconds=20 * i)) for i in range(300)] + [("c", T0 + timedelta(seconds=20 * 299 + 21))]


def walk(rows, gap):
    out, groups = set(), {}
    for g, t in rows:
        groups.setdefault(g, []).append(t)
    for g, times in groups.items():
        times.sort()
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > timedelta(seconds=gap):
                out.add((g, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((g, start, last, n))
    return out


@pytest.mark.parametrize("gap, part", [(20, 3600), (20, 50), (7, 60), (500, 30)])
def test_batch(spark, gap, part):
    rows = make(gap)
    hits = spark.createDataFrame([*rows, ("a", None)], SCHEMA)
    got = [tuple(r) for r in sessions(hits, ["g"], gap, part_seconds=part).collect()]
    assert set(got) == walk(rows, gap) and len(set(got)) == len(got)


def test_stream_gives_the_same(spark, tmp_path):
    rows = [r for r in make(3) if r[0] is not None]
    rows.sort(key=lambda r: r[1])
    src, out, mark = str(tmp_path / "hits"), str(tmp_path / "out"), str(tmp_path / "mark")
    for part in (rows[:200], rows[200:], [("end", T0 + timedelta(days=3))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run_out(spark, stream_sessions(spark.readStream.schema(SCHEMA).parquet(src), ["g"], 20, "30 seconds"), out, mark)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == walk(rows, 20)


def test_a_session_that_never_ends_spreads(spark):
    n = 20_000
    hits = spark.range(n).select(F.lit("hot").alias("g"), F.timestamp_micros(F.col("id") * 9_000_000).alias("time"))
    assert [(r["n"]) for r in sessions(hits, ["g"], 10).collect()] == [n]
    plan = sessions(hits, ["g"], 10)._jdf.queryExecution().optimizedPlan().toString()
    over_group = [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Window") and "__part" not in line]
    assert not over_group
