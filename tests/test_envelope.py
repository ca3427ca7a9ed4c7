import base64
import json

from pyspark.sql import functions as F

from eventlake.functions.variants import get, json_or_text
from eventlake.operators.envelope import (
    accepted,
    derived_id,
    from_json_values,
    push_events,
    to_output_record,
    uuid_text,
)
from eventlake.operators.normalise import nested_struct, remap, tag_logsource, unnest_records
from eventlake.sources import landing
from eventlake.sources.registry import SourceType, normalise, register_source, source_type


def landed(spark, *docs):
    rows = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
    return spark.createDataFrame(rows, "value string")


def as_dict(df):
    return [
        (r.event_id, json.loads(r.d), json.loads(r.m))
        for r in df.select("event_id", F.to_json("data").alias("d"), F.to_json("metadata").alias("m")).collect()
    ]


def test_push_events(spark):
    ident = base64.b64encode(bytes(range(16))).decode()
    meta = {
        "value": {"a": 1, "vector": {"ingest_timestamp": "t"}},
        "source_type": "file",
        "source_id": "s1",
        "source_event_id": ident,
    }
    df = push_events(
        landed(
            spark,
            {"log": {"value": '{"x":1}', "metadata_full": meta}},
            {"log": {"value": "plain", "metadata_full": {"value": {"correlation_uid": "c", "source_id": "old"}}}},
            {"log": {"fields": {"f": 2}, "metadata_full": {"value": 7, "source_event_id": "AAAA"}}},
            {"log": {"value": {"n": None}}},
            {"metric": {}},
            {"trace": {}},
            "{}",
            "oops",
        )
    )
    assert [r.reject_reason for r in df.collect()] == [None] * 4 + [
        "metric record", "trace record", "empty record", "malformed record",
    ]
    rows = as_dict(accepted(df))
    uid = "00010203-0405-0607-0809-0a0b0c0d0e0f"
    assert rows[0] == (
        uid,
        {"x": 1},
        {"a": 1, "timestamp": "t", "source_type": "file", "source_id": "s1", "correlation_uid": uid},
    )
    assert rows[1][1] == "plain" and rows[1][2] == {"correlation_uid": "c", "source_id": "old"}
    assert rows[2][1] == {"f": 2} and rows[2][2] == {"correlation_uid": rows[2][0]}
    assert rows[3][1] == {"n": None}


def test_ids_repeat(spark):
    df = landed(spark, {"log": {"value": "a"}}, {"log": {"value": "b"}})
    first = [r.event_id for r in push_events(df).collect()]
    assert first == [r.event_id for r in push_events(df).collect()]
    assert len(set(first)) == 2 and all(len(i) == 36 for i in first)
    assert spark.range(1).select(uuid_text(F.unhex(F.lit("00"))).alias("u")).first().u is None
    a, b = spark.range(1).select(
        derived_id(F.lit("a"), F.lit("b")).alias("a"), derived_id(F.lit("ab"), F.lit(None)).alias("b")
    ).first()
    assert a != b


def test_json_or_text(spark):
    rows = [('{"a":1}',), ("abc",), ("7",), ("",)]
    df = spark.createDataFrame(rows, "t string").select(F.to_json(json_or_text(F.col("t"))).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a":1}', '"abc"', "7", '""']


def test_output_record(spark, events):
    meta = '{"source_type":"t","source_id":"s","timestamp":"2024","vector":{"a":1}}'
    df = events(('{"x":1}', meta), ("7", "{}"))
    plain = [json.loads(r.record) for r in to_output_record(df).collect()]
    assert plain[0]["fields"] == {"x": 1} and plain[1]["fields"] == {}
    assert plain[0]["metadata_full"]["value"]["source_id"] == "s"
    full = [json.loads(r.record)["metadata_full"] for r in to_output_record(df, restore_source=True).collect()]
    assert full[0]["source_type"] == "t" and full[0]["source_id"] == "s"
    assert full[0]["value"] == {
        "timestamp": "2024", "vector": {"a": 1, "ingest_timestamp": "2024"}, "correlation_uid": "0",
    }
    assert full[1]["value"] == {"correlation_uid": "1"}


def test_unnest_and_tags(spark, events):
    df = events('{"Records":[{"eventName":"A"},{"eventName":"B"}]}', '{"x":1}', '{"Records":[]}')
    flat = unnest_records(df)
    assert [d for _, d, _ in as_dict(flat)] == [{"eventName": "A"}, {"eventName": "B"}]
    assert len({i for i, _, _ in as_dict(flat)}) == 2
    tagged = as_dict(tag_logsource(flat, product="aws"))
    assert tagged[0][2] == {"sigma": {"logsource": {"product": "aws"}}}
    assert as_dict(tag_logsource(flat))[0][2] == {}


def test_remap(spark, events):
    df = events('{"username":"bob","source_ip":"1.2.3.4"}')
    user = get(F.col("data"), "username", to="string")
    out = as_dict(remap(df, {"class_uid": F.lit(3002), "user.name": user}))[0]
    assert out[1]["user"] == {"name": "bob"} and json.loads(out[1]["raw_data"])["source_ip"] == "1.2.3.4"
    assert out[2] == {"ocsf": True}
    for bad in ({"a": user, "a.b": user}, {"a.b": user, "a": user}):
        try:
            nested_struct(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_registered_source(spark, events):
    register_source(
        SourceType("custom", product="p", mapping=lambda: {"class_uid": get(F.col("data"), "c", to="int")})
    )
    out = as_dict(normalise(events('{"c":7}'), "custom", "x"))[0]
    assert out[1]["class_uid"] == 7 and out[2]["source_id"] == "source-custom_x"
    try:
        source_type("nope")
    except KeyError:
        pass
    else:
        raise AssertionError("unknown source type accepted")


def test_readers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text('{"a":1}\n\noops\n')
    nd = landing.read_ndjson(spark, str(tmp_path / "n"))
    assert sorted(str(r.reject_reason) for r in nd.collect()) == ["None", "malformed record"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a").write_text('{"a":\n1}')
    (tmp_path / "h" / "b").write_text("text\nbody")
    bodies = [d for _, d, _ in as_dict(landing.read_http_bodies(spark, str(tmp_path / "h")))]
    assert sorted(map(str, bodies)) == ["text\nbody", "{'a': 1}"]
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a").write_text('{"Records":[{"eventName":"A",\n"eventID":"1"}]}')
    trail = normalise(accepted(landing.read_json_objects(spark, str(tmp_path / "o"))), "aws_cloudtrail", "m")
    assert as_dict(trail)[0][1]["api"]["operation"] == "A"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a").write_text('{"event":{"x":1},"host":"h","token":"t"}\n{"host":"h"}\n')
    hec = landing.read_hec(spark, str(tmp_path / "c"))
    assert sorted(str(r.reject_reason) for r in hec.collect()) == ["None", "no event member"]
    assert as_dict(accepted(hec))[0][1:] == (
        {"x": 1}, {"host": "h", "token": "t", "source_type": "splunk_hec"},
    )
    pushed = landing.read_pushed(spark, str(tmp_path / "n"))
    assert pushed.columns[-3:] == ["event_id", "data", "metadata"]


def test_bare_values(spark):
    df = spark.range(2).select("id", F.parse_json(F.lit("[1]")).alias("v"))
    out = as_dict(from_json_values(df, F.col("v"), ids=[F.col("id")]))
    assert [o[1:] for o in out] == [([1], {}), ([1], {})]
