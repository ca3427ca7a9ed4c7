"""Correlations over streams of rule hits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.model import FINDING_SCHEMA
from eventlake.operators.correlate import Correlation, _meets, correlate
from eventlake.operators.detect import build_findings
from eventlake.operators.route import CORRELATED, store_findings
from eventlake.operators.rules import Rule
from eventlake.operators.triage import in_range
from eventlake.session import remove_dir, scratch_dir
from eventlake.sources.store import read_findings


def windowed_counts(hits: DataFrame, spec: Correlation, delay: str, time: str = "time") -> DataFrame:
    """event_count or value_count per fixed window of one timespan, closed by the watermark.

    Counts are exact within each window; a burst across an edge is seen by `correlate_new` instead.
    """
    if spec.kind not in ("event_count", "value_count"):
        raise ValueError(f"{spec.kind} is not a count")
    # Hits of other rules move the watermark too: a condition on the time is not pushed below it.
    mine = F.col("rule_id").isin(list(spec.rules))
    if spec.kind == "value_count":
        mine = mine & F.col(spec.field).isNotNull()
    mine = hits.withWatermark(time, delay).where(F.when(F.col(time).isNotNull(), mine))
    window = F.window(time, f"{spec.span_seconds} seconds")
    if spec.kind == "event_count":
        counted = mine.groupBy(*spec.group_by, window).agg(F.count(F.lit(1)).alias("n"))
    else:
        # Two counting steps instead of a set per group: a hot group stays spread over its values.
        each = mine.groupBy(*spec.group_by, spec.field, window)
        again = F.window(F.window_time("window"), f"{spec.span_seconds} seconds")
        counted = each.agg(F.count(F.lit(1)).alias("__seen")).groupBy(*spec.group_by, again).agg(
            F.count(F.lit(1)).alias("n")
        )
    return counted.where(_meets(F.col("n"), spec.condition)).select(
        *spec.group_by,
        F.col("window.start").alias("start"),
        F.col("window.end").alias("end"),
        "n",
    )


def correlate_new(new: DataFrame, stored: Callable[[], DataFrame], spec: Correlation, time: str = "time") -> DataFrame:
    """Correlate a batch of hits against the stored ones (which already hold the batch).

    Re-evaluates every time the new hits can change: from the first of them to a timespan after the
    last, reading a timespan of history before that. Late hits are covered the same way. Output rows
    are keyed by (group, time); a later batch's row for a key replaces the earlier one.
    """
    edge = new.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    if edge is None or edge["low"] is None:
        return correlate(new, spec, time)
    span = F.expr(f"INTERVAL {spec.span_seconds} SECONDS")
    low, high = F.lit(edge["low"]), F.lit(edge["high"])
    window = in_range(stored(), low - span, high + span) if time == "time" else stored().where(F.col(time).between(low - span, high + span))
    return correlate(window, spec, time).where(F.col(time).between(low, high + span))


def observed_fields(specs: Iterable[Correlation]) -> list[str]:
    """The event fields that correlations group by or count: findings must keep them as observables."""
    return sorted({name for s in specs for name in (*s.group_by, *([s.field] if s.field else []))})


def _plain(name: str) -> str:
    return "by_" + re.sub(r"\W", "_", name)


def hits_of_findings(findings: DataFrame, fields: list[str]) -> DataFrame:
    """Findings as hits: rule_id, time, event_date, and the observed fields as columns."""
    columns = [F.get_json_object("observables", f"$['{name}']").alias(_plain(name)) for name in fields]
    return findings.select("rule_id", "time", "event_date", *columns)


def correlated_findings(spark: SparkSession, base: str, batch_id: int, specs: list[Correlation]) -> DataFrame:
    """New findings of correlations that the findings of a batch complete, read from the store.

    A finding of a correlation has its title and level, the time at which it was met, the group's fields as
    JSON in `metadata.correlation_uid`, and an id made of correlation, group and time. Those that an
    earlier batch has stored are left out, so hits that come late, and replays, add each of them once.
    """
    fields = observed_fields(specs)
    stored = read_findings(spark, base)
    new = hits_of_findings(stored.where(F.col("batch_id") == str(batch_id)), fields)
    rows = []
    for spec in specs:
        named = replace(spec, group_by=tuple(map(_plain, spec.group_by)), field=_plain(spec.field) if spec.field else None)
        met = correlate_new(new, lambda: hits_of_findings(stored, fields), named)
        group = F.to_json(F.struct(*[F.col(_plain(g)).alias(g) for g in spec.group_by])) if spec.group_by else F.lit("{}")
        rows.append(met.select(F.lit(spec.id).alias("rule_id"), "time", group.alias("correlation_uid"), group.alias("observables")))
    key = F.sha2(F.concat_ws("\u0001", "rule_id", "correlation_uid", F.unix_micros("time").cast("string")), 256)
    rules = [Rule(id=s.id, title=s.title, level=s.level, detection={}) for s in specs]
    found = build_findings(reduce(DataFrame.union, rows).withColumn("event_id", key), rules)
    ids = [s.id for s in specs]
    known = stored.where(F.col("rule_id").isin(ids) & (F.col("batch_id") != f"{CORRELATED}{batch_id}")).select(F.col("finding_info.uid").alias("__uid"))
    return found.join(known, F.col("finding_info.uid") == F.col("__uid"), "left_anti")


def store_correlated(spark: SparkSession, base: str, batch_id: int, specs: list[Correlation]) -> None:
    """Run the correlations on what a batch has stored, and store their findings beside it. A replay replaces them."""
    if specs:
        path = scratch_dir(spark, "correlated")  # read apart from the table it is added to
        correlated_findings(spark, base, batch_id, specs).write.parquet(path)
        store_findings(spark.read.schema(FINDING_SCHEMA).parquet(path), base, batch_id, CORRELATED)
        remove_dir(spark, path)
