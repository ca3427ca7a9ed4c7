import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlake.functions.variants import get
from eventlake.model import class_path
from eventlake.operators.correlate import correlate, correlation_from_dict
from eventlake.operators.envelope import accepted
from eventlake.operators.normalise import remap
from eventlake.operators.rules import rule_from_dict
from eventlake.session import scratch_dir
from eventlake.sources.landing import land_pushed, read_pushed, read_text
from eventlake.sources.store import read_class, read_findings, read_tree
from eventlake.streaming.correlation import windowed_counts
from eventlake.plans.q_stream import run_out
from eventlake.streaming.ingest import file_sink, start_ingest, without_repeats
from eventlake.streaming.sequence import Chain, stream_sequences

RULES = [rule_from_dict({"id": "odd", "level": "low", "title": "odd", "detection": {"s": {"n|gte": 3}, "condition": "s"}})]


def land(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"log": {"value": {"n": n}}}) for n in numbers] + ['{"metric":{}}']
    (folder / name).write_text("\n".join(lines) + "\n")


def to_class(events):
    n = get(F.col("data"), "n", to="int")
    return remap(events, {"class_uid": F.when(n == 5, 99999).otherwise(6003), "k": n})


def start(spark, landing, base, aside, mark, rules=lambda: RULES, sink=None):
    job = start_ingest(
        read_pushed(spark, str(landing), streaming=True, max_files=1),
        base=base, quarantine=aside, checkpoint=mark, rules=rules, normalise=to_class, sink=sink, every=None,
    )
    job.awaitTermination()


def test_stream_restart_and_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    base, aside, mark, out = (scratch_dir(spark, x) for x in "bqmo")
    land(landing, "a.json", range(4))
    start(spark, landing, base, aside, mark, sink=file_sink(out))
    land(landing, "b.json", range(4, 8))
    rules = []  # rules are read anew by each batch
    start(spark, landing, base, aside, mark, rules=lambda: rules, sink=file_sink(out))
    start(spark, landing, base, aside, mark, sink=file_sink(out))
    assert sorted(r.k for r in read_class(spark, base, 6003).collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert [r.rule_id for r in read_findings(spark, base).collect()] == ["odd"]
    reasons = sorted(r.reject_reason for r in read_tree(spark, aside).select("reject_reason").collect())
    assert reasons == ["metric record", "metric record", "unknown class_uid"]
    assert spark.read.option("recursiveFileLookup", "true").text(out).count() == 1
    # The same records in batch give the same rows.
    from eventlake.operators.route import store_batch

    other = scratch_dir(spark, "b")
    store_batch(to_class(accepted(read_pushed(spark, str(landing)))), other, scratch_dir(spark, "q"))
    as_text = lambda b: sorted(r.j for r in read_class(spark, b, 6003).drop("batch_id").select(F.to_json(F.struct("*")).alias("j")).collect())
    assert as_text(base) == as_text(other)
    assert spark.read.parquet(f"{base}/{class_path(6003)}/batch_id=0").count() == 4


def test_equal_lines_stay_and_a_file_sent_again_adds_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    base, aside, mark = (scratch_dir(spark, x) for x in "bqm")

    def run():
        start_ingest(
            read_text(spark, str(landing), streaming=True), base=base, quarantine=aside, checkpoint=mark, rules=lambda: RULES, normalise=to_class, land=land_pushed, every=None,
        ).awaitTermination()

    land(landing, "a.json", [1, 3, 3, 3])
    run()
    land(landing, "a.json", [1, 3, 3, 3])  # sent again under its name
    land(landing, "b.json", [3])
    run()
    assert sorted(r.k for r in read_class(spark, base, 6003).collect()) == [1, 3, 3, 3, 3]
    found = read_findings(spark, base).select("metadata.uid").collect()
    assert len(found) == len(set(found)) == 4
    in_batch = accepted(read_pushed(spark, str(landing)))
    assert {r.uid for r in found} <= {r.event_id for r in in_batch.collect()}


def test_without_repeats(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "a.json", [1, 2])
    (landing / "a.json").write_text((landing / "a.json").read_text() * 2)
    stream = without_repeats(accepted(read_pushed(spark, str(landing), streaming=True)), "1 hour")
    query = stream.select("event_id").writeStream.format("memory").queryName("norep").trigger(availableNow=True)
    query.option("checkpointLocation", scratch_dir(spark, "m")).start().awaitTermination()
    assert spark.table("norep").count() == 2


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "hits")
    spark.sql(
        """SELECT 'r' AS rule_id, 'g' || (id % 2) AS g, id % 3 AS v, timestamp_seconds(1700000000 + id * 20) AS time FROM range(60)"""
    ).coalesce(1).write.parquet(src)
    hits = spark.readStream.schema("rule_id string, g string, v long, time timestamp").parquet(src)
    for kind, low in (("event_count", 2), ("value_count", 2)):
        body = {"type": kind, "rules": "r", "group-by": ["g"], "timespan": "2m", "condition": {"gte": low, "field": "v"}}
        out = windowed_counts(hits, correlation_from_dict({"id": kind, "correlation": body}), "10 seconds")
        name = f"win_{kind}"
        writer = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        writer.option("checkpointLocation", scratch_dir(spark, "m")).start().awaitTermination()
        agg = "count(*)" if kind == "event_count" else "count(DISTINCT v)"
        want = spark.read.parquet(src).groupBy("g", F.window("time", "2 minutes").alias("w")).agg(F.expr(agg).alias("n"))
        last = spark.read.parquet(src).agg(F.max("time") - F.expr("INTERVAL 10 SECONDS")).first()[0]
        expected = {(r.g, r.w.start, r.n) for r in want.collect() if r.n >= low and r.w.end <= last}
        assert {(r.g, r.start, r.n) for r in spark.table(name).collect()} == expected and expected


@pytest.mark.parametrize("kind", ["temporal", "temporal_ordered"])
def test_sequences_over_several_batches(spark, tmp_path, kind):
    """Hits in three files, late ones within the delay among them, and a restart between the files: as in batch."""
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    hits = [(rng.choice(["r1", "r2", "r3", "r9"]), rng.choice(["a", "a", "b", None]), t0 + timedelta(seconds=rng.randrange(1500) / 2)) for _ in range(300)]
    hits.sort(key=lambda h: h[2] + timedelta(seconds=rng.randrange(25)))  # out of order by less than the delay
    schema = "rule_id string, g string, time timestamp"
    src, out, mark = str(tmp_path / "hits"), str(tmp_path / "out"), str(tmp_path / "mark")
    body = {"type": kind, "rules": ["r1", "r2", "r3", "r1"], "group-by": ["g"], "timespan": "45s"}
    spec = correlation_from_dict({"id": kind, "correlation": body})
    for part in (hits[:100], hits[100:200], hits[200:], [("end", None, t0 + timedelta(days=9))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        run_out(spark, stream_sequences(stream, spec, "30 seconds"), out, mark)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    want = {tuple(r) for r in correlate(spark.createDataFrame(hits, schema), spec).collect()}
    assert set(got) == want and len(got) == len(want) > 5


def test_chain_of_one_group():
    chain = Chain([[0], [1]], 2, 10, True)
    reached = [None, None]
    steps = [(1, {0}), (5, {1}), (11, {1}), (12, {1}), (20, {0, 1}), (21, {1})]
    assert [chain.at(reached, us, seen) for us, seen in steps] == [False, True, True, False, True, True]
