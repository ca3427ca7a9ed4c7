"""Correlation rules over rule hits: event_count, value_count, temporal, temporal_ordered.

All look back over (t - timespan .. t), both ends included, for every hit time t of a group. Work is
laid out per (group, time slice of one timespan): a hit takes part in its own slice and, as context,
in the next one. A slice is cut into short parts, and hits at the same instant are merged before the
shuffle. A part is summed up in one row; the rows of a slice's parts, taken in order, give the state
with which each part begins, and that is joined back to it. So a group holding most of the data
spreads over many tasks, also when all of it lies within one timespan, and every kind of correlation
is one shuffle of the hits into parts, whatever the number of its rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.rules import RuleError, load_documents

# Units of a timespan, in seconds.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
KINDS = ("event_count", "value_count", "temporal", "temporal_ordered")
PARTS = 64  # parts of a timespan
COMPARISONS = {"gte": ">=", "gt": ">", "lte": "<=", "lt": "<", "eq": "="}


@dataclass(frozen=True)
class Correlation:
    id: str
    kind: str
    rules: tuple[str, ...]
    group_by: tuple[str, ...]
    span_seconds: int
    condition: tuple[tuple[str, float], ...] = ()
    field: str | None = None
    title: str | None = None
    level: str | None = None


def span_seconds(text: str) -> int:
    match = re.fullmatch(r"(\d+)([smhdw])", text.strip())
    if not match:
        raise RuleError(f"unusable timespan {text!r}")
    return int(match.group(1)) * UNITS[match.group(2)]


def correlation_from_dict(doc: dict) -> Correlation:
    body = doc.get("correlation")
    if not isinstance(body, dict) or body.get("type") not in KINDS:
        raise RuleError(f"not a correlation rule: {doc.get('title')}")
    condition = dict(body.get("condition") or {})
    field = condition.pop("field", None)
    unknown = set(condition) - set(COMPARISONS)
    if unknown:
        raise RuleError(f"unknown comparison {sorted(unknown)}")
    if body["type"] in ("event_count", "value_count") and not condition:
        raise RuleError(f"{body['type']} needs a condition")
    if body["type"] == "value_count" and not field:
        raise RuleError("value_count needs condition.field")
    rules = body.get("rules") or []
    return Correlation(
        id=str(doc.get("id") or doc.get("title")),
        kind=body["type"],
        rules=tuple([rules] if isinstance(rules, str) else rules),
        group_by=tuple(body.get("group-by") or ()),
        span_seconds=span_seconds(body["timespan"]),
        condition=tuple(condition.items()),
        field=field,
        title=doc.get("title"),
        level=doc.get("level"),
    )


def load_correlations(paths: str | Iterable[str]) -> list[Correlation]:
    """The correlation documents of one or more folders of rule files."""
    return [correlation_from_dict(doc) for _, doc in load_documents(paths) if isinstance(doc, dict) and "correlation" in doc]


def _meets(value: Column, condition: tuple[tuple[str, float], ...]) -> Column:
    ok = F.lit(True)
    for name, bound in condition:
        ok = ok & {
            "gte": value >= bound,
            "gt": value > bound,
            "lte": value <= bound,
            "lt": value < bound,
            "eq": value == bound,
        }[name]
    return ok


def correlate(hits: DataFrame, spec: Correlation, time: str = "time") -> DataFrame:
    """Times at which a group meets the correlation: group columns, time, and the count `n`.

    `hits` has rule_id, the time, the group columns and, for value_count, the counted field.
    For the temporal kinds `n` is the number of rules in the set.
    """
    mine = hits.where(F.col("rule_id").isin(list(spec.rules)) & F.col(time).isNotNull())
    mine = mine.withColumn("__us", F.unix_micros(F.col(time).cast("timestamp")))
    if spec.kind == "event_count":
        counted = event_counts(mine, list(spec.group_by), spec.span_seconds)
        met = counted.where(_meets(F.col("n"), spec.condition))
    elif spec.kind == "value_count":
        counted = value_counts(mine, list(spec.group_by), spec.field, spec.span_seconds)
        met = counted.where(_meets(F.col("n"), spec.condition))
    else:
        met = sequences(mine, list(spec.group_by), spec.rules, spec.span_seconds, spec.kind == "temporal_ordered")
    return met.select(*spec.group_by, F.timestamp_micros("__us").alias(time), "n")


def _slices(df: DataFrame, span: int) -> DataFrame:
    """Each row in its own slice and, with __own false, in the next one."""
    slot = F.floor(F.col("__us") / (span * 1_000_000))
    both = F.array(
        F.struct(slot.alias("slot"), F.lit(True).alias("own")),
        F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")),
    )
    return df.withColumn("__s", F.explode(both)).select(
        "*", F.col("__s.slot").alias("__slot"), F.col("__s.own").alias("__own")
    ).drop("__s")


def _parts(rows: DataFrame, keys: list[str], span: int) -> tuple[DataFrame, list[str]]:
    """Rows brought together by part, and the keys of a part. `keys` end with the slice and what else tells rows apart."""
    width = max(span * 1_000_000 // PARTS, 1)
    # Never NULL; said here, so that what the joins infer does not tell apart the two readers of this shuffle.
    known = rows.where("__us IS NOT NULL AND __own IS NOT NULL")
    cut = known.withColumn("__part", F.floor(F.col("__us") / width))
    return cut.repartition(*keys, "__part"), [*keys, "__part"]


def _upto(keys: list[str]):
    """From the beginning of a part, all rows of the current instant included."""
    return Window.partitionBy(*keys).orderBy("__us").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier(keys: list[str]):
    """The parts of a slice before the current one."""
    return Window.partitionBy(*keys[:-1]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def _begun(cut: DataFrame, summary: DataFrame, keys: list[str], carried: dict[str, Column], context: bool = False) -> DataFrame:
    """The rows of the parts with the state their part begins with.

    `summary` has a row for each part, with `__any` (it has rows of its own slice) and `__to` (its last
    time) beside what `carried` is computed from. Without `context` only parts with `__any` are of further
    use. Both sides read all columns of `cut`, so that they share its shuffle.
    """
    before = summary.select(*keys, "__any", "__to", *[c.alias(n) for n, c in carried.items()])
    left, right = cut.alias("l"), before if context else before.where("__any")
    right = right.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    within = (F.col("l.__us") <= F.col("r.__to")) & (F.col("l.__own") <= F.col("r.__any"))
    both = left.join(right, reduce(lambda x, y: x & y, same) & within)
    return both.select("l.*", *[F.col(f"r.{n}") for n in carried])


def _summary(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bool_or("__own").alias("__any"), F.max("__us").alias("__to"), *[c.alias(n) for n, c in sums.items()])


def _at_instants(rows: DataFrame, group: list[str], keys: list[str], kept: Column, n: Column) -> DataFrame:
    """One row (group, __us, n) for each instant of a slice's own rows that has a `kept` one."""
    chosen = rows.where(F.col("__own") & F.coalesce(kept, F.lit(False)))
    before = F.lag("__us").over(Window.partitionBy(*keys).orderBy("__us"))
    once = chosen.withColumn("__back", before).where("__back IS NULL OR __back <> __us")
    return once.select(*group, "__us", n.cast("bigint").alias("n"))


def _sweep(deltas: DataFrame, group: list[str], span: int) -> DataFrame:
    """Running sum of +/- changes per slice, all changes of an instant included."""
    cut, keys = _parts(deltas, [*group, "__slot"], span)
    total = _summary(cut, keys, __total=F.sum("__d"))
    rows = _begun(cut, total, keys, {"__before": F.sum("__total").over(_earlier(keys))})
    n = F.sum("__d").over(_upto(keys)) + F.coalesce("__before", F.lit(0))
    return _at_instants(rows.withColumn("__n", n), group, keys, F.lit(True), F.col("__n"))


def _changes(rows: DataFrame, group: list[str], span: int, amount: Column, starts: Column, ends: Column) -> DataFrame:
    """+amount at the time, -amount just after the time leaves the window (one microsecond later)."""
    gone = F.col("__us") + F.lit(span * 1_000_000 + 1)
    steps = F.array(
        F.struct(F.col("__us").alias("us"), F.when(starts, amount).otherwise(F.lit(0)).alias("d"), F.col("__own").alias("own")),
        F.struct(gone.alias("us"), F.when(ends, -amount).otherwise(F.lit(0)).alias("d"), F.lit(False).alias("own")),
    )
    return rows.select(*group, "__slot", F.explode(steps).alias("c")).select(
        *group,
        "__slot",
        F.col("c.us").alias("__us"),
        F.col("c.d").cast("bigint").alias("__d"),
        F.col("c.own").alias("__own"),
    )


def event_counts(hits: DataFrame, group: list[str], span: int) -> DataFrame:
    """Hits of the group in the look-back window, per hit time."""
    instants = hits.groupBy(*group, "__us").agg(F.count(F.lit(1)).alias("__n"))
    yes = F.lit(True)
    return _sweep(_changes(_slices(instants, span), group, span, F.col("__n"), yes, yes), group, span)


def value_counts(hits: DataFrame, group: list[str], field: str, span: int) -> DataFrame:
    """Distinct non-null values of a field in the look-back window, per hit time.

    A value counts from its first sighting until a timespan after its last one: only the ends of a
    run of sightings that are at most a timespan apart change the count. The sightings of one value
    are cut into parts as well.
    """
    instants = hits.groupBy(*group, "__us", F.col(field).alias("__value")).agg(F.lit(1).alias("__one")).drop("__one")
    cut, keys = _parts(_slices(instants, span), [*group, "__slot", "__value"], span)
    seen = _summary(cut, keys, __from=F.min("__us"))
    later = Window.partitionBy(*keys[:-1]).orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    # Parts without rows of their own slice matter here too: their sightings end runs.
    rows = _begun(cut, seen, keys, {"__last": F.max("__to").over(_earlier(keys)), "__next": F.min("__from").over(later)}, context=True)
    order = Window.partitionBy(*keys).orderBy("__us")
    reach = F.lit(span * 1_000_000)
    back = F.col("__us") - F.coalesce(F.lag("__us").over(order), "__last")
    ahead = F.coalesce(F.lead("__us").over(order), "__next") - F.col("__us")
    known = F.col("__value").isNotNull()
    starts = known & (F.col("__back").isNull() | (F.col("__back") > reach))
    ends = known & (F.col("__ahead").isNull() | (F.col("__ahead") > reach))
    rows = rows.select(*group, "__slot", "__us", "__own", "__value", back.alias("__back"), ahead.alias("__ahead"))
    return _sweep(_changes(rows, group, span, F.lit(1), starts, ends), group, span)


def sequences(hits: DataFrame, group: list[str], rules: tuple[str, ...], span: int, ordered: bool) -> DataFrame:
    """Hit times by which every rule of the set was seen in the look-back window.

    Ordered: the rules were seen one after the other (ties allowed) in the given order, and the
    time is that of the last rule. Per step only the latest possible start is carried along.
    """
    instants = hits.groupBy(*group, "__us", "rule_id").agg(F.lit(1).alias("__one")).drop("__one")
    cut, keys = _parts(_slices(instants, span), [*group, "__slot"], span)
    us, low = F.col("__us"), F.col("__us") - span * 1_000_000
    steps = range(len(rules))
    is_rule = [F.col("rule_id") == r for r in rules]
    if not ordered:
        latest = _summary(cut, keys, **{f"__s{i}": F.max(F.when(is_rule[i], us)) for i in steps})
        rows = _begun(cut, latest, keys, {f"__b{i}": F.max(f"__s{i}").over(_earlier(keys)) for i in steps})
        seen = [F.greatest(f"__b{i}", F.max(F.when(is_rule[i], us)).over(_upto(keys))).alias(f"__c{i}") for i in steps]
        rows = rows.select(*group, *[k for k in keys if k not in group], "__us", "__own", *seen)
        met = reduce(lambda x, y: x & y, [F.col(f"__c{i}") >= low for i in steps])
    else:
        # Latest start of a chain of the rules a to i within the part.
        inside = cut
        for i in steps:
            chain = {f"__l{i}_{i}": us} | {f"__l{a}_{i}": F.col(f"__l{a}_{i - 1}") for a in range(i)}
            inside = inside.withColumns({n: F.max(F.when(is_rule[i], c)).over(_upto(keys)) for n, c in chain.items()})
        pairs = [(a, i) for i in steps for a in range(i + 1)]
        chains = _summary(inside, keys, **{f"__l{a}_{i}": F.max(f"__l{a}_{i}") for a, i in pairs})
        # What a slice has reached, part by part: a chain goes on where the part holds the rest of it.
        part = F.struct(*[f"__l{a}_{i}" for a, i in pairs])
        none = F.array(*[F.lit(None).cast("long")] * len(rules))

        def after(reached: Column, part: Column) -> Column:
            new = []
            for i in steps:
                longer = [F.when(part[f"__l{a}_{i}"].isNotNull(), reached[a - 1]) for a in range(1, i + 1)]
                new.append(F.greatest(reached[i], part[f"__l0_{i}"], *longer))
            return F.array(*new)

        reached = F.aggregate(F.collect_list(part).over(_earlier(keys)), none, after)  # at most a slice's parts
        rows = _begun(cut, chains, keys, {"__reached": reached})
        start: Column = us
        for i in steps:
            rows = rows.withColumn(f"__c{i}", F.greatest(F.col("__reached")[i], F.max(F.when(is_rule[i], start)).over(_upto(keys))))
            start = F.col(f"__c{i}")
        met = is_rule[-1] & (start >= low)
    return _at_instants(rows, group, keys, met, F.lit(len(rules)))

