"""The rule index against the predicate form, and the literals read off patterns."""

import bisect
import json
import random
import re

import pytest

from eventlake.operators import ruleindex
from eventlake.operators.detect import match_rules, prepare_events, prepare_table
from eventlake.operators.patterns import required_runs
from eventlake.operators.predicates import BodyFields
from eventlake.operators.ruleindex import _nodes, anchors_of
from tests.test_rules import CONDITIONS, TRUTH, rule


def hits(prepared, rules, strategy, keep=None):
    return sorted(tuple(r) for r in match_rules(prepared, rules, keep, strategy=strategy).collect())


def test_all_kinds_of_rules(events):
    """Every rule of the truth table on every event of it, by index and by predicates."""
    rules = [rule(sel=sel, rule_id=f"t{i}") for i, (sel, _, _) in enumerate(TRUTH)]
    rules += [rule(c, a={"x": 1}, b={"y": 1}, rule_id=f"c{i}") for i, (c, _) in enumerate(CONDITIONS)]
    df = events(*[data for _, data, _ in TRUTH], '{"x":1,"y":1}', '{"x":1}', '{"y":1}', "{}")
    by_index = hits(prepare_events(df), rules, "index")
    assert by_index == hits(prepare_events(df), rules, "expr")
    assert len(set(by_index)) == len(by_index) and len(anchors_of(BodyFields(), rules)) > 25


def random_rules(rng, count):
    words = ["alpha", "beta", "gamma", "delta", "al", "mm", "Ωmega", "a b", "x{y}", "50%", "new\\\\line", "it's"]

    def value():
        return "".join(rng.choice([rng.choice(words), rng.choice(words), "*", "?", "-"]) for _ in range(rng.randrange(1, 4)))

    def values():
        return value() if rng.random() < 0.6 else [value() for _ in range(rng.randrange(1, 4))]

    def entry():
        name = rng.choice(["f", "g", "h.k"])
        mods = rng.choice(["", "|contains", "|contains|all", "|startswith", "|endswith", "|cased", "|contains|cased", "|windash|contains", "|re", "|gt", "|exists", "|base64offset|contains"])
        if mods == "|re":
            return name + mods, rng.choice(["(?i)ALPHA.*(beta|gam)", "be(ta)?.alpha", r"a\sb", "^(?:gamma)+$", "[a-g]{5}", r"\Qx{y}\E+", "delta|beta"])
        if mods in ("|gt", "|exists"):
            return name + mods, rng.choice([0, 1, 7])
        return name + mods, values()

    def selection():
        if rng.random() < 0.1:
            return rng.sample(words, 2)
        body = dict(entry() for _ in range(rng.randrange(1, 4)))
        return [body, dict([entry()])] if rng.random() < 0.15 else body

    made = []
    for i in range(count):
        condition = rng.choice(["a", "a and b", "a or b", "a and not b", "1 of them", "all of a*", "2 of them", "(a or b) and not c", ["a", "b and c"]])
        source = rng.choice([None, None, {"product": "p0"}, {"product": "p1", "service": "s"}])
        made.append(rule(condition, a=selection(), b=selection(), c=selection(), rule_id=f"r{i}", logsource=source))
    return made


def random_texts(rng, count):
    words = ["alpha", "BETA", "gamma", "delta", "al", "mm", "ωmega", "ΩMEGA", "a b", "X{y}", "50%", "new\\line", "It's", "-", " ", "YWxwaGE=", "7", "2"]
    one = lambda: "".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    return [one() for _ in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules_on_json_events(events, seed):
    rng = random.Random(seed)
    rules = random_rules(rng, 150)
    rows = []
    for text in random_texts(rng, 120):
        some = lambda: rng.choice([text, rng.choice(random_texts(rng, 1)), random_texts(rng, 3), 7, None])
        body = {"f": some(), "g": some(), "h": rng.choice([{"k": some()}, [{"k": text}, {"k": "beta"}], "beta"])}
        source = {"logsource": {"product": f"p{rng.randrange(2)}", "service": "s"}}
        rows.append((json.dumps(body, ensure_ascii=False), json.dumps(source)))
    prepared = prepare_events(events(*rows))
    by_index = hits(prepared, rules, "index")
    assert by_index == hits(prepared, rules, "expr") and len(by_index) > 500
    assert len(anchors_of(BodyFields(), rules)) > 40


def test_random_rules_on_columns(spark):
    rng = random.Random(3)
    rules = random_rules(rng, 120)
    rows = [(i, rng.choice([f, None]), [g, f], (float(i % 9),)) for i, (f, g) in enumerate(zip(random_texts(rng, 150), random_texts(rng, 150)))]
    df = spark.createDataFrame(rows, "event_id int, f string, g array<string>, h struct<k:double>")
    rules = [r for r in rules if r.service is None]
    by_index = hits(prepare_table(df, product="p0"), rules, "index")
    assert by_index == hits(prepare_table(df, product="p0"), rules, "expr") and len(by_index) > 100


def test_joins_without_broadcast_and_a_rule_reached_twice(events, monkeypatch):
    monkeypatch.setattr(ruleindex, "BROADCAST_BYTES", 0)
    rules = [rule("a or b", a={"f|contains": ["alpha", "beta"]}, b={"g": ["x", "y"]}, rule_id=f"r{i}") for i in range(3)]
    rules += [rule("a", a={"n|gt": 3}, rule_id="number"), rule("not a", a={"n|lt": 4}, rule_id="z")]
    df = events('{"f":"alpha beta","g":["x","y"]}', '{"f":"beta"}', '{"g":"Y","n":4}', '{"f":"alp beta x"}', '{"f":"bet"}')
    want = [(str(e), f"r{i}") for e in range(4) for i in range(3)] + [("2", "number"), *[(str(e), "z") for e in range(5)]]
    assert hits(prepare_events(df), rules, "index") == sorted(want)


def test_the_plan_grows_with_shapes_only(events):
    def plan(count):
        rules = [rule(sel={"f|contains": f"needle {i}", "n|gt": i, "g": [f"v{i}", f"w{i}"]}, rule_id=f"r{i}") for i in range(count)]
        return match_rules(prepare_events(events("{}")), rules)._jdf.queryExecution().optimizedPlan().toString()

    # Beside the shapes only the cut points of a number, 1023 at most.
    assert abs(len(plan(8000)) - len(plan(2000))) < 200


def test_the_rarest_anchor_is_taken():
    rules = [rule(sel={"code": 4104, "text|contains|all": ["run this now", f"special{i:03}"]}, rule_id=f"s{i}") for i in range(40)]
    found = anchors_of(BodyFields(), rules)
    assert all(len(found[r.id]) == 1 for r in rules) and len({next(iter(found[r.id])) for r in rules}) >= 30
    crowded = [rule(sel={"code": 4104, "user": i % 7, "n|gt": i}, rule_id=f"c{i}") for i in range(400)]
    found = anchors_of(BodyFields(), crowded)
    assert all({m.name for m in a} == {"n", "user"} for s in found.values() for a in s)  # two marks together


def test_ranges_cover_their_side():
    cuts = [float(c) for c in range(0, 1000, 3)]
    for value in (-1.0, 0.0, 1.0, 500.0, 998.0, 999.0, 5000.0):
        rank = bisect.bisect_right(cuts, value)
        shown = {(level, rank >> level) for level in range(len(cuts).bit_length() + 1)}
        for bound in (-5.0, 0.0, 1.0, 2.9, 300.0, 999.0, 2000.0):
            at = bisect.bisect_right(cuts, bound)
            above = {(m.level, m.at) for (m,) in _nodes("f", at, len(cuts))}
            below = {(m.level, m.at) for (m,) in _nodes("f", 0, at)}
            assert (value < bound or shown & above) and (value > bound or shown & below)
            assert len(above) <= 2 * len(cuts).bit_length() and (rank >= at) == bool(shown & above)


RUNS = [
    ("abc", ["abc"]), ("^abc$", ["abc"]), ("abc?d", ["ab", "d"]), ("ab+c", ["ab", "c"]), ("ab{2,3}c", ["ab", "c"]), ("ab{0,3}c", ["a", "c"]),
    ("(abc)d", ["abc", "d"]), ("(abc)?d", ["d"]), ("(?:abc)+d", ["abc", "d"]), ("a(b|c)d", ["a", "d"]), ("abc|abd", []), ("(?i)aBc", ["aBc"]),
    ("(?x)a b", []), (r"\Qa.b\Ec", ["a.bc"]), (r"a\.b\\c", [r"a.b\c"]), (r"a\db", ["a", "b"]), ("a[bc]d", ["a", "d"]), (r"a[\]b]+d", ["a", "d"]),
    ("a[b[cd]e]f", ["a", "f"]), ("(?=abc)d", ["d"]), ("(?<!abc)d", ["d"]), ("(?<name>abc)d", ["abc", "d"]), (r"(a)\1", []), ("a.b", ["a", "b"]),
    (r"a\tb", ["a\tb"]), ("a*+b", ["b"]), ("", []), ("(", []), ("a)", []), ("a{", []), (r"\p{L}abc", ["abc"]), (r"\x41bc", ["bc"]), ("(?i:abc)d", ["abc", "d"]),
]


@pytest.mark.parametrize("pattern, runs", RUNS, ids=[p for p, _ in RUNS])
def test_required_runs(pattern, runs):
    assert required_runs(pattern) == runs


def test_every_match_holds_the_runs():
    """Random patterns on random texts: what matches holds all runs."""
    rng = random.Random(11)
    atoms = ["a", "b", "c", "ab", "(?:ab|c)", "(bc)", "[ab]", ".", r"\w", "(?:a(?:bc)?)", r"\.", "^", r"\b"]
    matched = 0
    for _ in range(3000):
        pattern = "".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,2}", "+?"]) if a else "|" if rng.random() < 0.1 else rng.choice(atoms) for a in range(rng.randrange(1, 6)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        runs = required_runs(pattern)
        for _ in range(10):
            text = "".join(rng.choice("abc.") for _ in range(rng.randrange(8)))
            if compiled.search(text):
                matched += 1
                assert all(run in text for run in runs), (pattern, text, runs)
    assert matched > 5000
