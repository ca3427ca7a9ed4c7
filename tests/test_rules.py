import itertools
import random

import pytest

from eventlake.operators.detect import check_regexes, detect, match_rules, prepare_events, prepare_table
from eventlake.operators.predicates import BodyFields, _encoded, _with_dashes, split_wildcards
from eventlake.operators.ruleindex import anchors_of
from eventlake.operators.rules import (
    RuleError,
    get_rule,
    list_rules,
    load_rules,
    merge_rules,
    rule_facets,
    rule_from_dict,
    rule_from_text,
    rule_table,
    rules_of_table,
    set_enabled,
)

SAMPLE = """
title: Tape robot door opened
description: The door of a tape library was opened outside its service hours
logsource:
  product: tapelib
  service: robot
detection:
  door:
    code: 71
    note|contains:
      - 'door open'
      - 'hatch open'
  condition: door
level: high
"""


def rule(condition="sel", rule_id="r", logsource=None, **selections):
    return rule_from_dict(
        {"id": rule_id, "title": rule_id, "detection": {**selections, "condition": condition}, "logsource": logsource}
    )


def matches(events, data, r, strategy="auto"):
    df = events(data)
    return match_rules(prepare_events(df), [r], strategy=strategy).count() == 1


TRUTH = [
    ({"f": "ABC"}, '{"f":"abc"}', True),
    ({"f": "a*c"}, '{"f":"xabc"}', False),
    ({"f": "a*c"}, '{"f":"A\\nBC"}', True),
    ({"f": "a?c"}, '{"f":"abc"}', True),
    ({"f": "a?c"}, '{"f":"ac"}', False),
    ({"f": r"a\*c"}, '{"f":"a*c"}', True),
    ({"f": r"a\*c"}, '{"f":"abc"}', False),
    ({"f": "100%_x"}, '{"f":"100%_x"}', True),
    ({"f": "1?0%*"}, '{"f":"100%_x"}', True),
    ({"f": "1?0%*"}, '{"f":"100x"}', False),
    ({"f": "*"}, '{"f":"x"}', True),
    ({"f": "*"}, '{"g":"x"}', False),
    ({"f": ""}, '{"f":""}', True),
    ({"f": ""}, '{"g":1}', False),
    ({"f": ["a", "b"]}, '{"f":"B"}', True),
    ({"f": 4104}, '{"f":4104}', True),
    ({"f": 4104}, '{"f":"4104"}', True),
    ({"f": True}, '{"f":true}', True),
    ({"f|contains": "'q\\"}, '{"f":"x\'q\\\\y"}', True),
    ({"f|contains|all": ["a", "b"]}, '{"f":"xbxa"}', True),
    ({"f|contains|all": ["a", "b"]}, '{"f":"xb"}', False),
    ({"f|startswith": "Ab"}, '{"f":"aBc"}', True),
    ({"f|endswith": "bC"}, '{"f":"aBc"}', True),
    ({"f|endswith": "b*c"}, '{"f":"aBxxc"}', True),
    ({"f|cased": "Ab"}, '{"f":"ab"}', False),
    ({"f|re": "^A.c$"}, '{"f":"Abc"}', True),
    ({"f|re": "^A.c$"}, '{"f":"abc"}', False),
    ({"f|re|i": "^A.c$"}, '{"f":"abc"}', True),
    ({"f|re|s": "a.c"}, '{"f":"a\\nc"}', True),
    ({"f|re": "a.c"}, '{"f":"a\\nc"}', False),
    ({"f|re|m": "^c$"}, '{"f":"a\\nc"}', True),
    ({"f|cidr": "10.1.0.0/16"}, '{"f":"10.1.255.3"}', True),
    ({"f|cidr": "10.1.0.0/16"}, '{"f":"10.2.0.1"}', False),
    ({"f|cidr": "10.1.0.0/16"}, '{"f":"10.1.0.256"}', False),
    ({"f|cidr": "2001:db8::/33"}, '{"f":"2001:DB8:7fff::1"}', True),
    ({"f|cidr": "2001:db8::/33"}, '{"f":"2001:db8:8000::1"}', False),
    ({"f|cidr": "::ffff:0:0/96"}, '{"f":"::ffff:1.2.3.4"}', True),
    ({"f|cidr": ["10.0.0.0/8", "fe80::/10"]}, '{"f":["x","fe80::1"]}', True),
    ({"f|gt": 5}, '{"f":"5.5"}', True),
    ({"f|gte": 5, "f|lt": 6}, '{"f":5}', True),
    ({"f|lte": 5}, '{"f":"x"}', False),
    ({"f|exists": True}, '{"f":null}', True),
    ({"f|exists": False}, '{"g":1}', True),
    ({"f": None}, '{"f":null}', True),
    ({"f": None}, "{}", True),
    ({"f": None}, '{"f":0}', False),
    ({"f|fieldref": "g"}, '{"f":"A","g":"a"}', True),
    ({"f|endswith|fieldref": "g"}, '{"f":"xxA","g":"a"}', True),
    ({"f|base64": "foo"}, '{"f":"Zm9v"}', True),
    ({"f|base64offset|contains": "foo"}, '{"f":"eGZvbw=="}', True),
    ({"f|wide|base64|contains": "ab"}, '{"f":"xYQBiAA==x"}', True),
    ({"f|windash|contains": " -enc"}, '{"f":"run /enc"}', True),
    ({"f|windash|contains": " -enc"}, '{"f":"run +enc"}', False),
    ({"a.b": "x"}, '{"a":{"b":"X"}}', True),
    ({"a.b": "x"}, '{"a":[{"b":"y"},{"b":"X"}]}', True),
    ({"a.b|contains": "x"}, '{"a":{"b":["y","axa"]}}', True),
    ({"f": ["a", "b"]}, '{"f":["b","a"]}', True),
    (["two words"], '{"g":[{"h":"has TWO words"}]}', True),
    (["key"], '{"key":"value"}', False),
    (['say "hi"'], '{"g":"I SAY \\"hi\\""}', True),
    (["key\":"], '{"key":"value"}', False),
    ({"|all": ["one", "two"]}, '{"g":"one","h":["two"]}', True),
    ([{"f": 1}, {"g": 2}], '{"g":2}', True),
]


@pytest.mark.parametrize("sel,data,expected", TRUTH, ids=[f"{i}-{t[0]}" for i, t in enumerate(TRUTH)])
def test_truth(events, sel, data, expected):
    assert matches(events, data, rule(sel=sel)) is expected


CONDITIONS = [
    ("a and b", [True, False, False, False]),
    ("a or b", [True, True, True, False]),
    ("a and not b", [False, True, False, False]),
    ("not (a or b)", [False, False, False, True]),
    ("not a and b or a", [True, True, True, False]),
    ("1 of them", [True, True, True, False]),
    ("all of them", [True, False, False, False]),
    ("2 of them", [True, False, False, False]),
    ("any of a*", [True, True, False, False]),
    ("NOT a AND b", [False, False, True, False]),
]


@pytest.mark.parametrize("condition,expected", CONDITIONS, ids=[c[0] for c in CONDITIONS])
def test_conditions(events, condition, expected):
    """Over both true, only a, only b, none (there by absent fields: negation is two-valued)."""
    r = rule(condition, a={"x": 1}, b={"y": 1})
    df = events('{"x":1,"y":1}', '{"x":1}', '{"y":1}', "{}")
    hit = {row.event_id for row in match_rules(prepare_events(df), [r]).collect()}
    assert [str(i) in hit for i in range(4)] == expected


def test_condition_errors(events):
    df = events("{}")
    for condition in ("sel | count() > 5", "other", "1 of other*"):
        with pytest.raises(RuleError):
            match_rules(prepare_events(df), [rule(condition, sel={"f": 1})])
    for bad in ({"f|nope": 1}, {"f|cidr": "x"}, {"f|gt": "x"}, {"f": []}, {}):
        with pytest.raises(RuleError):
            match_rules(prepare_events(df), [rule(sel=bad)])
    with pytest.raises(RuleError):
        match_rules(prepare_events(df), [rule(sel={"f|re": "("})])


def test_check_regexes(spark):
    check_regexes(spark, ["a+", "(?i)b"])
    with pytest.raises(RuleError):
        check_regexes(spark, ["a+", "*"])


def test_sample_rule(events):
    r = rule_from_text(SAMPLE)
    assert r.level == "high" and len(r.id) == 32
    source = '{"logsource":{"product":"tapelib","service":"robot"}}'
    df = events(
        ('{"code":71,"note":"the Hatch Open lamp"}', source),
        ('{"code":71,"note":"the Hatch Open lamp"}', '{"logsource":{"product":"linux"}}'),
        ('{"code":1,"note":"hatch open"}', source),
    )
    found = detect(df, [r]).collect()
    assert [f.metadata.uid for f in found] == ["0"]
    assert found[0].severity == "high" and found[0].class_uid == 2004


def test_raw_body_is_matched(events):
    df = events(('{"raw_data":"{\\"f\\":1}","f":2}', '{"ocsf":false}'), '{"raw_data":"{\\"f\\":1}","f":2}')
    hits = match_rules(prepare_events(df), [rule(sel={"f": 1}, rule_id="one"), rule(sel={"f": 2}, rule_id="two")])
    assert {(h.event_id, h.rule_id) for h in hits.collect()} == {("0", "one"), ("1", "two")}


def test_lookup_equals_predicates(events):
    """Random equality rules over random events, arrays included: both forms give the same hits."""
    rng = random.Random(7)
    words = ["a", "b", "c", "1", "2"]

    def value():
        picks = ['"%s"' % rng.choice(words), rng.choice(["1", "2", "null"])]
        return rng.choice(picks + ["[" + ",".join('"%s"' % rng.choice(words) for _ in range(3)) + "]", "[]"])

    rows = []
    for _ in range(150):
        body = ",".join(f'"{k}":{value()}' for k in ("f", "g") if rng.random() < 0.9)
        meta = '{"logsource":{"product":"p%d"}}' % rng.randrange(2)
        rows.append(("{" + body + "}", meta))
    rules = []
    for i in range(60):
        sel = {k: rng.sample(words, rng.randrange(1, 4)) for k in rng.choice([("f",), ("g",), ("f", "g")])}
        rules.append(rule(rule_id=f"r{i}", sel=sel, logsource={"product": "p1"} if i % 3 == 0 else None))
    rules.append(rule(rule_id="text", sel={"f|contains": "a"}))
    assert set(anchors_of(BodyFields(), rules)) == {r.id for r in rules[:-1]}  # one character is no anchor
    df = events(*rows)
    by = {
        s: sorted((h.event_id, h.rule_id) for h in match_rules(prepare_events(df), rules, strategy=s).collect())
        for s in ("expr", "index")
    }
    assert by["expr"] == by["index"] and len(by["expr"]) > 100
    assert len(set(by["index"])) == len(by["index"])


def test_table_reads_only_named_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "'x' AS a", "'y' AS b").write.parquet(path)
    df = spark.read.parquet(path)
    hits = match_rules(prepare_table(df), [rule(sel={"a": "X"})], keep=["id"])
    assert hits.count() == 10
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,a:string>" in plan


def test_fixed_logsource_drops_other_rules(spark):
    df = spark.range(3).selectExpr("id", "'x' AS a")
    rules = [rule(rule_id="w", sel={"a": "x"}, logsource={"product": "windows"}), rule(rule_id="any", sel={"a": "x"})]
    hits = match_rules(prepare_table(df, product="linux"), rules, keep=["id"])
    assert {h.rule_id for h in hits.collect()} == {"any"}


def test_helpers():
    assert split_wildcards(r"a\\*b\?") == [("x", "a\\"), ("*", ""), ("x", "b?")]
    assert len(_with_dashes("run -a /b c-d")) == 25
    assert _encoded(b"foo", True) == ["Zm9v", "Zvb", "mb2"]


def test_load(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.yml").write_text(SAMPLE)
    (tmp_path / "two.yaml").write_text(SAMPLE + "id: two\n")
    assert {r.title for r in load_rules(str(tmp_path))} == {"Tape robot door opened"}
    assert len(load_rules([str(tmp_path / "a"), str(tmp_path)][1:])) == 2
    (tmp_path / "bad.yaml").write_text("title: x")
    with pytest.raises(RuleError):
        load_rules(str(tmp_path))
    with pytest.raises(RuleError):
        load_rules(str(tmp_path / "missing"))


def test_rule_table(spark):
    rules = [rule(rule_id="a", sel={"f": 1}), rule(rule_id="b", sel={"f": 2}, logsource={"product": "p"})]
    rules = set_enabled(rules, "a", False)
    table = rule_table(spark, rules)
    assert rules_of_table(table) == rules
    merged, conflicts = merge_rules(table, rule_table(spark, [rules[0], rule(rule_id="c", sel={"f": 3})]))
    assert sorted(r.id for r in merged.collect()) == ["a", "b", "c"]
    assert [r.id for r in conflicts.collect()] == ["a"]
    assert list_rules(table).count() == 0  # none has a description
    assert get_rule(table, "b").count() == 1
    assert rule_facets(table).first().products == ["p"]
    with pytest.raises(KeyError):
        set_enabled(rules, "zz", True)


def test_disabled_rules_do_not_match(events):
    r = set_enabled([rule(sel={"f": 1})], "r", False)
    assert match_rules(prepare_events(events('{"f":1}')), r).count() == 0


def test_many_logsource_groups(events):
    rules = [
        rule(rule_id=f"{p}-{i}", sel={"f|gte": i}, logsource={"product": p} if p else None)
        for p, i in itertools.product(["a", "b", None], range(4))
    ]
    df = events(('{"f":2}', '{"logsource":{"product":"a"}}'), ('{"f":9}', '{"logsource":{"product":"c"}}'))
    hits = sorted((h.event_id, h.rule_id) for h in match_rules(prepare_events(df), rules).collect())
    expected = [("0", f"{p}-{i}") for p in ("None", "a") for i in range(3)] + [("1", f"None-{i}") for i in range(4)]
    assert hits == sorted(expected)
