"""Lookups by the id index give what a scan of all findings gives, and open few files."""

import pytest
from pyspark.sql import functions as F

from eventlake.model import FINDING_CLASS_UID
from eventlake.operators import idindex
from eventlake.operators.compact import compact, expire
from eventlake.operators.detect import build_findings
from eventlake.operators.idindex import fetch_indexed, find_files, index_batch, merge_index
from eventlake.operators.route import store_findings
from eventlake.operators.rules import rule_from_dict
from eventlake.operators.triage import fetch_alert
from eventlake.session import scratch_dir
from eventlake.sources.store import read_findings

RULES = [rule_from_dict({"id": f"r{i}", "title": f"t{i}", "detection": {"s": {"a": 1}, "condition": "s"}}) for i in range(3)]


def write(spark, base, batch, ids):
    hits = spark.createDataFrame([(i, f"r{k}") for i in ids for k in range(1 + int(i[-1]) % 3)], "event_id string, rule_id string")
    day = F.timestamp_millis(F.lit(1_700_000_000_000) + F.crc32("event_id") % 3 * 86_400_000)
    store_findings(build_findings(hits.select("*", day.alias("time"), F.lit("c").alias("correlation_uid")), RULES), base, batch)
    index_batch(spark, base, batch)


def same(spark, base, ids):
    stored = read_findings(spark, base)
    opened = []
    for uid in ids:
        rows, lookup = fetch_indexed(spark, base, uid)
        assert rows.collect() == fetch_alert(stored, uid).collect()
        opened.append((lookup.index_files, len(lookup.finding_files)))
    return opened


def test_lookups_at_every_stage(spark, monkeypatch):
    monkeypatch.setattr(idindex, "BUCKET_ROWS", 4)
    base = scratch_dir(spark, "store")
    assert same(spark, base, ["none"]) == [(0, 0)] and merge_index(spark, base) is None
    for batch in range(3):
        write(spark, base, batch, [f"e{batch}{i}" for i in range(5)])
    ids = ["e00", "e14", "e22", "gone"]
    assert same(spark, base, ids)[0][1] == 1
    merged = merge_index(spark, base)
    assert merged.endswith("of=4")
    assert all(index <= 1 and found == (uid != "gone") for uid, (index, found) in zip(ids, same(spark, base, ids)))
    compact(spark, base, FINDING_CLASS_UID)
    expire(spark, base, FINDING_CLASS_UID, 0)
    assert all(found == (uid != "gone") for uid, (_, found) in zip(ids, same(spark, base, ids)))
    write(spark, base, 1, [f"e1{i}" for i in range(5)])  # a replay of a packed batch
    write(spark, base, 3, ["e30", "e00"])
    assert [found for _, found in same(spark, base, [*ids, "e30"])] == [2, 1, 1, 0, 1]
    for batch in range(4, 8):
        write(spark, base, batch, [f"e{batch}0"])
        merge_index(spark, base)
    assert same(spark, base, ["e40", "e22"])[0][0] <= idindex.SEGMENTS and find_files(spark, base, "e70").finding_files


@pytest.mark.parametrize("ids", [[], ["e1", "e2"]])
def test_a_replay_replaces_its_segment(spark, ids):
    base = scratch_dir(spark, "store")
    write(spark, base, 0, ["e1", "e3"])
    write(spark, base, 0, ids)
    same(spark, base, ["e1", "e2", "e3"])
