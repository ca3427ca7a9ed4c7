"""Thousands of rules as rows: shapes, constants, and an index of the literals every match must hold.

Rules that differ only in their constants share a shape, one predicate over columns of constants. An
anchor is something an event must show for a rule to match: a field equal to a text, a field that holds
a run of `GRAM` characters, a number within a range, an address within a network, or two of these together. Each rule gets one set of
anchors of which every match shows at least one, chosen so that few other rules share them. Events emit
the keys of what they show, a join finds the rules with such an anchor, and the shape's predicate
verifies the pair. The plan grows with the shapes and the fields, not with the rules; an event meets
only rules one of whose anchors it shows.

Ranges: the numbers that rules compare a field with cut its values into at most `CUTS` + 1 ranges, the
leaves of a binary tree. A bound is the few nodes that cover what lies beyond it, and an event's number
shows the nodes above its leaf.
"""

from __future__ import annotations

import ast
import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions.net import digits, network_prefix, prefix
from eventlake.operators.patterns import required_runs
from eventlake.operators.predicates import (
    COMPARE,
    CONDITION,
    Constants,
    Fields,
    named_selections,
    literal_pieces,
    spellings,
    rule_test,
    sql_text,
)
from eventlake.operators.rules import Rule

GRAM = 3  # characters of a run
KEYWORDS = ""  # the pseudo-field of keyword searches
# Rule rows up to this many bytes of constants are broadcast; beyond, Spark picks the joins by size.
BROADCAST_BYTES = 64 << 20
# A rule with more anchors than this is left to the predicate form.
MOST_ANCHORS = 5000
# Marks shared by more rules than this are taken in pairs, up to so many pairs; cut points of a field.
CROWD, MOST_PAIRS, CUTS = 16, 256, 1023
SEPARATOR = "\u0001"
NONE = "CAST(array() AS ARRAY<BIGINT>)"


class Mark(NamedTuple):
    """Something an event shows in a field: its text, a run of its characters, or a range its number lies in."""

    name: str
    kind: str  # text, gram, node or net
    text: str = ""
    level: int = 0
    at: int = 0


Anchor = tuple[Mark, ...]  # one mark, or two shown together
Anchors = frozenset[Anchor]


def cut_points(rules: Iterable[Rule]) -> dict[str, list[float]]:
    """Per field some of the numbers that rules compare it with, in order: the ends of the smallest ranges."""
    seen: dict[str, set[float]] = {}

    def entries(body: Any) -> None:
        for part in body if isinstance(body, list) else [body]:
            for key, value in part.items() if isinstance(part, dict) else ():
                name, *mods = str(key).split("|")
                if set(mods) & set(COMPARE):
                    for v in value if isinstance(value, list) else [value]:
                        number = _number(v)
                        if number is not None:
                            seen.setdefault(name, set()).add(number)

    for rule in rules:
        for name, body in rule.detection.items():
            if name not in ("condition", "timeframe"):
                entries(body)
    cuts = {}
    for name, numbers in seen.items():
        ordered = sorted(numbers)
        cuts[name] = sorted({ordered[i * len(ordered) // min(len(ordered), CUTS)] for i in range(min(len(ordered), CUTS))})
    return cuts


def _number(value: Any) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def _levels(cuts: list[float]) -> int:
    return len(cuts).bit_length()


def _nodes(name: str, first: int, last: int) -> Anchors:
    """Ranges of a binary tree that together cover the ranks first to last."""
    found, level = set(), 0
    last += 1
    while first < last:
        if first & 1:
            found.add((Mark(name, "node", level=level, at=first),))
            first += 1
        if last & 1:
            last -= 1
            found.add((Mark(name, "node", level=level, at=last),))
        first, last, level = first >> 1, last >> 1, level + 1
    return frozenset(found)


def _grams(runs: Iterable[str]) -> set[str]:
    return {run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)}


def _plain_runs(text: str) -> list[str]:
    """Runs of ASCII: case folding of other characters may depend on what stands beside them."""
    return re.findall(r"[\x00-\x7f]+", text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else "\x80" for c in text))


class _Needs:
    """Anchor sets of a rule's parts; `weigh` tells how many rules share a mark."""

    def __init__(self, fields: Fields, weigh: Callable[[Mark], int], cuts: dict[str, list[float]]) -> None:
        self.fields, self.weigh, self.cuts = fields, weigh, cuts

    def _cost(self, anchors: Anchors) -> tuple:
        worst = max(min((self.weigh(m), m.kind) for m in a) for a in anchors)
        return worst, len(anchors), sorted(anchors)

    def best(self, options: list[Anchors | None]) -> Anchors | None:
        """All parts must hold: any part's set will do. Where the best one is crowded, it is taken with the next."""
        known = sorted((o for o in options if o), key=self._cost)
        if not known:
            return None
        first = known[0]
        if self._cost(first)[0][0] > CROWD and all(len(a) == 1 for a in first):
            for other in known[1:]:
                apart = {m.name for (m, *_) in first}.isdisjoint(m.name for a in other for m in a)
                if apart and all(len(a) == 1 for a in other) and len(first) * len(other) <= MOST_PAIRS:
                    return frozenset(tuple(sorted((*a, *b))) for a in first for b in other)
        return first

    def either(self, parts: list[Anchors | None]) -> Anchors | None:
        """Some part must hold: the sets of all are needed."""
        if not parts or any(not p for p in parts):
            return None
        return frozenset().union(*parts)

    def _runs(self, name: str, runs: list[str]) -> Anchors | None:
        """The least crowded of the runs."""
        marks = [Mark(name, "gram", g) for g in sorted(_grams(runs))]
        return frozenset([(min(marks, key=lambda m: (self.weigh(m), m)),)]) if marks else None

    def _range(self, name: str, op: str, value: Any) -> Anchors | None:
        number, cuts = _number(value), self.cuts.get(name)
        if number is None or not cuts:
            return None
        rank = bisect.bisect_right(cuts, number)
        return _nodes(name, rank, len(cuts)) if op in ("gt", "gte") else _nodes(name, 0, rank)

    def entry(self, key: str, value: Any) -> Anchors | None:
        name, *mods = key.split("|")
        values = value if isinstance(value, list) else [value]
        if {"exists", "fieldref"} & set(mods) or None in values or not values:
            return None
        where = next((m for m in ("contains", "startswith", "endswith") if m in mods), "equals")
        compare = next((m for m in mods if m in COMPARE), None)
        found = []
        for v in values:
            if "re" in mods:
                found.append(self._runs(name, [r for run in required_runs(str(v)) for r in _plain_runs(run)]))
                continue
            if "cidr" in mods:
                version, bits, start = network_prefix(str(v))
                found.append(frozenset([(Mark(name, "net", start, version, bits),)]))
                continue
            if compare:
                found.append(self._range(name, compare, v))
                continue
            several, literal = spellings(v, mods)
            needs = []
            for text in several:
                pieces = literal_pieces(text, where, literal)
                if [kind for kind, _ in pieces] == ["x"] and pieces[0][1].isascii():
                    needs.append(frozenset([(Mark(name, "text", pieces[0][1].lower()),)]))
                else:
                    needs.append(self._runs(name, [r for kind, t in pieces if kind == "x" for r in _plain_runs(t)]))
            found.append(self.either(needs))
        return self.best(found) if "all" in mods else self.either(found)

    def keywords(self, words: Any, every: bool) -> Anchors | None:
        found = []
        for word in words if isinstance(words, list) else [words]:
            pieces = literal_pieces(str(word), "contains", False)
            runs = [r for kind, t in pieces if kind == "x" for r in _plain_runs(self.fields.spell_keyword(t.lower()))]
            found.append(self._runs(KEYWORDS, runs))
        return self.best(found) if every else self.either(found)

    def selection(self, body: Any) -> Anchors | None:
        if isinstance(body, dict):
            parts = []
            for key, value in body.items():
                name, _, mods = key.partition("|")
                parts.append(self.entry(key, value) if name else self.keywords(value, "all" in mods.split("|")))
            return self.best(parts)
        if isinstance(body, list):
            maps = [self.selection(m) for m in body if isinstance(m, dict)]
            words = [w for w in body if not isinstance(w, dict)]
            return self.either(maps + ([self.keywords(words, False)] if words else []))
        return self.keywords([body], False)

    def condition(self, detection: dict) -> Anchors | None:
        selections = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
        leaves: dict[str, Anchors | None] = {}

        def leaf(match: re.Match) -> str:
            if not match.group(1):
                word = match.group(0)
                if word.lower() in ("and", "or", "not"):
                    return word.lower()
                needs = self.selection(selections[word]) if word in selections else None
            else:
                each = [self.selection(selections[n]) for n in named_selections(selections, match.group(2))]
                needs = self.best(each) if match.group(1).lower() == "all" else self.either(each)
            leaves[f"s{len(leaves)}"] = needs
            return f"s{len(leaves) - 1}"

        def walk(node: ast.expr) -> Anchors | None:
            if isinstance(node, ast.BoolOp):
                parts = [walk(v) for v in node.values]
                return self.best(parts) if isinstance(node.op, ast.And) else self.either(parts)
            return leaves[node.id] if isinstance(node, ast.Name) else None  # a negation shows nothing

        conditions = detection["condition"]
        texts = conditions if isinstance(conditions, list) else [conditions]
        try:
            trees = [ast.parse(" ".join(CONDITION.sub(leaf, t).split()), mode="eval").body for t in texts]
        except SyntaxError:  # the predicate form will say so
            return None
        return self.either([walk(t) for t in trees])


def anchors_of(fields: Fields, rules: Iterable[Rule], cuts: dict[str, list[float]] | None = None) -> dict[str, Anchors]:
    """For each rule that has one, a set of anchors of which every match shows at least one."""
    rules = list(rules)
    cuts = cut_points(rules) if cuts is None else cuts
    shared: Counter = Counter()
    for rule in rules:
        seen: set[Mark] = set()
        _Needs(fields, lambda m: seen.add(m) or 0, cuts).condition(rule.detection)
        shared.update(seen)
    needs = _Needs(fields, lambda m: shared[m], cuts)
    chosen = {rule.id: needs.condition(rule.detection) for rule in rules}
    return {k: v for k, v in chosen.items() if v and len(v) <= MOST_ANCHORS}


@dataclass
class RuleIndex:
    """Rows of the indexed rules, the predicates of their shapes, and the keys an event emits."""

    cuts: dict[str, list[float]] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)
    shapes: dict[str, int] = field(default_factory=dict)
    slots: dict[tuple[str, str], int] = field(default_factory=dict)
    used: dict[tuple[int, ...], None] = field(default_factory=dict)  # slots of the anchors, alone or in pairs
    single: dict[int, bool] = field(default_factory=dict)  # whether an event has at most one mark of a slot
    nets: dict[str, set[tuple[int, int]]] = field(default_factory=dict)  # (version, prefix length) in use
    size: int = 0

    SCHEMA = (
        "__rule int, __shape int, __c array<array<string>>, __n array<double>, "
        "__a array<array<struct<slot:int,kind:string,text:string,level:int,at:int>>>, __id string"
    )

    def add(self, fields: Fields, rule: Rule, anchors: Anchors, logsource: dict[str, str]) -> None:
        """Add a rule; `logsource` names the event's column for each part."""
        fields.constants = constants = Constants()
        try:
            parts = [f"{logsource[p]} = {fields.literal(v)}" for p, v in zip(logsource, rule.logsource) if v is not None]
            text = " AND ".join([*parts, f"({rule_test(fields, rule)})"])
        finally:
            fields.constants = None
        shape = self.shapes.setdefault(text, len(self.shapes))
        marks = []
        for anchor in sorted(anchors):
            for m in anchor:
                if m.kind == "net":
                    self.nets.setdefault(m.name, set()).add((m.level, m.at))
            marks.append([(self.slots.setdefault((m.name, m.kind), len(self.slots)), *m[1:]) for m in anchor])
            self.used[tuple(m[0] for m in marks[-1])] = None
        self.rows.append((len(self.rows), shape, constants.texts, constants.numbers, marks, rule.id))
        self.size += 64 + sum(len(t) for texts in constants.texts for t in texts) + 40 * len(marks) + len(rule.id)

    def verify(self) -> str:
        """Boolean SQL over an event's columns and a rule's row."""
        if len(self.shapes) == 1:
            return next(iter(self.shapes))
        return "CASE __shape " + " ".join(f"WHEN {i} THEN {text}" for text, i in self.shapes.items()) + " END"

    def table(self, spark: SparkSession) -> DataFrame:
        """(rule row …, __keys): the anchors as hashes, made by the same functions as an event's keys."""
        letters = ", ".join(f"substring(m.text, {i + 1}, 1)" for i in range(GRAM))
        mark = (
            f"CASE m.kind WHEN 'text' THEN xxhash64(m.slot, m.text) WHEN 'gram' THEN xxhash64(m.slot, {letters}) "
            "WHEN 'net' THEN xxhash64(m.slot, m.level, m.at, m.text) ELSE xxhash64(m.slot, m.level, m.at) END"
        )
        pair = "CASE WHEN size(h) = 1 THEN h[0] ELSE xxhash64(h[0], h[1]) END"
        keys = f"array_distinct(transform(transform(__a, a -> transform(a, m -> {mark})), h -> {pair}))"
        return spark.createDataFrame(self.rows, self.SCHEMA).select("__rule", "__shape", "__c", "__n", "__id", F.expr(keys).alias("__keys"))

    def mark_columns(self, fields: Fields) -> tuple[dict[str, str], dict[str, str]]:
        """(columns that the marks are read from, columns with an event's marks: one for each slot, or an array)."""
        sources, marks = {}, {}
        for (name, kind), slot in self.slots.items():
            items = fields.keyword_texts() if name == KEYWORDS else fields.elements(name)
            self.single[slot] = items is None and kind == "text"
            if kind == "node":
                levels = _levels(self.cuts[name])
                # One literal that is folded to an array: a list of a thousand would slow down the planning.
                known = f"CAST(split('{','.join(map(repr, self.cuts[name]))}', ',') AS ARRAY<DOUBLE>)"
                steps = ", ".join(str(1 << i) for i in reversed(range(levels)))
                rank = f"aggregate(array({steps}), 0, (r, s) -> IF(coalesce(get({known}, r + s - 1) <= {{v}}, false), r + s, r))"
                each = ", ".join(f"xxhash64({slot}, {level}, shiftright({{r}}, {level}))" for level in range(levels + 1))
                if items is None:
                    value = fields.number(name)
                    sources[f"__r{slot}"] = f"CASE WHEN {value} IS NOT NULL THEN {rank.format(v=value)} END"
                    marks[f"__m{slot}"] = f"CASE WHEN __r{slot} IS NOT NULL THEN array({each.format(r=f'__r{slot}')}) ELSE {NONE} END"
                else:
                    known_values = f"filter({fields.numbers(name)}, v -> v IS NOT NULL)"
                    sources[f"__r{slot}"] = f"transform({known_values}, v -> {rank.format(v='v')})"
                    marks[f"__m{slot}"] = f"array_distinct(flatten(transform(__r{slot}, r -> array({each.format(r='r')}))))"
                continue
            if kind == "net":
                # One key for each prefix length in use, whatever the number of networks.
                texts = f"array({fields.text(name)})" if items is None else f"coalesce({items}, array({fields.text(name)}))"
                lists = []
                for version in sorted({v for v, _ in self.nets[name]}):
                    each = ", ".join(f"xxhash64({slot}, {version}, {bits}, {prefix('d', str(bits))})" for v, bits in sorted(self.nets[name]) if v == version)
                    hexed = f"filter(transform({texts}, x -> {digits('x', version)}), d -> d IS NOT NULL)"
                    lists.append(f"flatten(transform({hexed}, d -> array({each})))")
                marks[f"__m{slot}"] = f"array_distinct(concat({', '.join(lists)}))"
                continue
            alone = "CAST(NULL AS STRING)" if name == KEYWORDS else fields.lowered(name)
            values = items if name == KEYWORDS or items is None else f"transform({items}, x -> lower(x))"
            if kind == "text":
                one = f"CASE WHEN {alone} IS NOT NULL THEN xxhash64({slot}, {alone}) END"
                several = f"CASE WHEN {items} IS NULL THEN array_compact(array({one})) ELSE transform({values}, x -> xxhash64({slot}, x)) END"
                marks[f"__m{slot}"] = one if items is None else several
                continue
            text = f"coalesce(array_join({values}, {sql_text(SEPARATOR)}), {alone})" if values else alone
            sources[f"__g{slot}"] = f"split({text}, '')"
            at = ", ".join(f"__g{slot}[i + {k}]" if k else f"__g{slot}[i]" for k in range(GRAM))
            runs = f"transform(sequence(0, size(__g{slot}) - {GRAM}), i -> xxhash64({slot}, {at}))"
            marks[f"__m{slot}"] = f"CASE WHEN size(__g{slot}) >= {GRAM} THEN array_distinct({runs}) ELSE {NONE} END"
        return sources, marks

    def keys(self) -> str:
        """SQL of an event's distinct keys, over its marks."""
        alone, lists = [], []
        for slots in self.used:
            first, *second = [f"__m{s}" for s in slots]
            if not second:
                (alone if self.single[slots[0]] else lists).append(first)
            elif self.single[slots[0]] and self.single[slots[1]]:
                alone.append(f"CASE WHEN {first} IS NOT NULL AND {second[0]} IS NOT NULL THEN xxhash64({first}, {second[0]}) END")
            else:
                left, right = (f"array_compact(array({m}))" if self.single[s] else m for s, m in zip(slots, (first, second[0])))
                lists.append(f"flatten(transform({left}, a -> transform({right}, b -> xxhash64(a, b))))")
        if not lists:
            return f"array_compact(array({', '.join(alone)}))"  # of slots of their own, so distinct
        return f"array_distinct(concat({', '.join([*lists, *([f'array_compact(array({", ".join(alone)}))'] if alone else [])])}))"


def indexed_hits(index: RuleIndex, shown: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, rule_id) of `shown`: a row for each key of an event, with all its `__keys` and its fields' columns.

    Rows that name an `__id` already are hits themselves. A rule reached over several anchors counts once,
    over the first of its anchors that the event shows.
    """
    rules = index.table(shown.sparkSession)
    anchors = rules.select("__rule", F.explode_outer("__keys").alias("__key"))
    bodies = rules.withColumnRenamed("__keys", "__mine").withColumnRenamed("__id", "__rule_id")
    if index.size <= BROADCAST_BYTES:
        anchors, bodies = F.broadcast(anchors), F.broadcast(bodies)
    how = "left" if "__id" in shown.columns else "inner"
    first = "(size(__mine) = 1 OR element_at(filter(__mine, k -> array_contains(__keys, k)), 1) = __key)"
    found = shown.join(anchors, "__key", how)
    if how == "inner":
        hits = found.join(bodies, "__rule").where(index.verify()).where(first)
        return hits.select(*keep, F.col("__rule_id").alias("rule_id"))
    found = found.where("__id IS NOT NULL OR __rule IS NOT NULL").join(bodies, "__rule", "left")
    hits = found.where(f"__id IS NOT NULL OR (({index.verify()}) AND {first})")
    return hits.select(*keep, F.coalesce("__id", "__rule_id").alias("rule_id"))
