"""Match events against all rules in one pass, and build findings from the hits.

A few rules become one list of predicates per logsource, behind a guard on the event's logsource. Where
rules are many, those that have an anchor go through the rule index instead, as rows of a table; see
`ruleindex`. Both feed the same `explode`, so events are read and parsed once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.variants import epoch_time, get, kind, strict_string, variant_of
from eventlake.model import FINDING_CLASS_UID, PRODUCT_NAME
from eventlake.operators.envelope import logsource_of, with_entries
from eventlake.operators.normalise import detection_body
from eventlake.operators.predicates import (
    BodyFields,
    Fields,
    TableFields,
    rule_test,
    sql_text,
)
from eventlake.operators.ruleindex import RuleIndex, anchors_of, cut_points, indexed_hits
from eventlake.operators.rules import Rule, RuleError, merge_rules, rules_of_table

PARTS = ("product", "service", "category")

SEPARATOR = "\u0001"  # of rule ids within a text

# From about this many anchored rules on, the index beats one predicate per rule.
INDEX_FROM = 300
# Texts of the finding dimension up to this many characters are broadcast; beyond, Spark picks the join.
BROADCAST_CHARACTERS = 64 << 20


@dataclass(frozen=True)
class Prepared:
    """Events ready for matching: the fields rules may name, and the logsource of each row."""

    df: DataFrame
    fields: Fields
    logsource: dict[str, str]  # part -> SQL text of the event's value
    fixed: dict[str, str | None] | None = None  # the logsource when it is the same for all rows

    def may_match(self, rule: Rule) -> bool:
        if self.fixed is None:
            return True
        wanted = dict(zip(PARTS, rule.logsource))
        return all(v is None or v == self.fixed.get(p) for p, v in wanted.items())

    def guard(self, logsource: tuple[str | None, str | None, str | None]) -> str:
        if self.fixed is not None:
            return ""
        return " AND ".join(
            f"{self.logsource[p]} = {sql_text(v)}" for p, v in zip(PARTS, logsource) if v is not None
        )


def prepare_events(events: DataFrame) -> Prepared:
    """Events with VARIANT data: rules see the detection body, the logsource comes from metadata."""
    source = logsource_of(F.col("metadata"))
    df = events.withColumns(
        {
            "__body": detection_body(F.col("data"), F.col("metadata")),
            **{f"__{p}": source[p] for p in PARTS},
        }
    )
    return Prepared(df, BodyFields(), {p: f"__{p}" for p in PARTS})


def prepare_table(df: DataFrame, **logsource: str | None) -> Prepared:
    """A table with declared columns (a stored class, say) whose rows share one logsource.

    Rules for another logsource drop out before planning, and only the named columns are read.
    """
    return Prepared(df, TableFields(schema=df.schema), {}, {p: logsource.get(p) for p in PARTS})


def check_regexes(spark: SparkSession, patterns: Iterable[str]) -> None:
    """Fail early on patterns the regex engine refuses. One projection tries them all."""

    def compiles(some: list[str]) -> bool:
        try:
            spark.range(1).selectExpr(*[f"'' RLIKE {sql_text(p)}" for p in some]).collect()
            return True
        except Exception:
            return False

    todo = sorted(set(patterns))
    if todo and not compiles(todo):
        bad = next(p for p in todo if not compiles([p]))
        raise RuleError(f"bad pattern {bad!r}")


def usable_rules(events: DataFrame, rules: Iterable[Rule]) -> tuple[list[Rule], dict[str, str]]:
    """(rules that compile for `events`, reasons by id of those that don't).

    Each rule is compiled once; the patterns of all rules are tried in one projection, and one by one
    only when that fails.
    """
    good, refused, patterns = [], {}, {}
    for rule in rules:
        fields = BodyFields()
        try:
            rule_test(fields, rule)
        except RuleError as exc:
            refused[rule.id] = str(exc)
            continue
        patterns[rule.id] = set(fields.regexes)
        good.append(rule)
    try:
        check_regexes(events.sparkSession, set().union(*patterns.values()) if patterns else ())
        return good, refused
    except RuleError:
        for rule in list(good):
            try:
                check_regexes(events.sparkSession, patterns[rule.id])
            except RuleError as exc:
                good.remove(rule)
                refused[rule.id] = str(exc)
        return good, refused


def add_rules(table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule table with the new rules, refused ones as id and reason).

    A rule is added when it compiles and its id is free. The new rules pass through the driver, where rules
    are compiled; the table stays where it is.
    """
    spark = table.sparkSession
    _, bad = usable_rules(new, rules_of_table(new.where("id IS NOT NULL")))
    reasons = spark.createDataFrame(list(bad.items()), "id string, reason string")
    merged, conflicts = merge_rules(table, new.join(F.broadcast(reasons), "id", "left_anti"))
    taken = conflicts.select("id", F.when(F.col("id").isNull(), "no id").otherwise("id is taken").alias("reason"))
    return merged, reasons.union(taken)


def match_rules(
    prepared: Prepared,
    rules: Iterable[Rule],
    keep: list[str] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """One row per (event, matching enabled rule): the `keep` columns and `rule_id`.

    `strategy`: 'expr' compiles every rule to a predicate, 'index' sends every rule that has anchors
    through the rule index, 'auto' does so from INDEX_FROM of them on.
    """
    df, fields = prepared.df, prepared.fields
    keep = ["event_id"] if keep is None else keep
    active = [r for r in rules if r.enabled and prepared.may_match(r)]
    if prepared.fixed is not None:  # checked above; no part is left to test per row
        active = [Rule(id=r.id, title=r.title, detection=r.detection) for r in active]

    cuts = cut_points(active)
    anchors = anchors_of(fields, active, cuts) if strategy == "index" or (strategy == "auto" and len(active) >= INDEX_FROM) else {}
    if strategy == "auto" and len(anchors) < INDEX_FROM:
        anchors = {}
    index = RuleIndex(cuts)
    groups: dict[tuple, list[str]] = {}
    for rule in active:
        if rule.id in anchors:
            index.add(fields, rule, anchors[rule.id], prepared.logsource)
            continue
        text = f"CASE WHEN {rule_test(fields, rule)} THEN {sql_text(rule.id)} END"
        groups.setdefault(rule.logsource, []).append(text)
    # The ids of a logsource's matching rules, as one text: NULLs cost nothing there, whereas an
    # array would have to be filtered element by element.
    matched = {}
    for i, (logsource, texts) in enumerate(groups.items()):
        ids = f"concat_ws({sql_text(SEPARATOR)}, {', '.join(texts)})"
        guard = prepared.guard(logsource)
        matched[f"__h{i}"] = f"CASE WHEN {guard} THEN {ids} END" if guard else ids

    sources, marks = index.mark_columns(fields)
    check_regexes(df.sparkSession, fields.regexes)
    read = [*fields.columns, *prepared.logsource.values()] if marks else []
    extracted = df.select(
        *keep,
        *prepared.logsource.values(),
        *[F.expr(sql).alias(name) for name, sql in fields.columns.items()],
    ).select(*keep, *read, *[F.expr(sql).alias(name) for name, sql in {**matched, **sources}.items()])
    if not matched and not marks:
        return extracted.select(*keep, F.lit("").alias("rule_id")).where("false")

    some = " OR ".join(f"{h} <> ''" for h in matched)
    joined_ids = f"concat_ws({sql_text(SEPARATOR)}, {', '.join(matched)})"
    parts = f"array_remove(split({joined_ids}, {sql_text(SEPARATOR)}), '')"
    if not marks:
        return extracted.select(*keep, F.expr(f"explode(CASE WHEN {some} THEN {parts} END)").alias("rule_id"))

    shown = extracted.select(*keep, *read, *matched, *[F.expr(sql).alias(name) for name, sql in marks.items()])
    shown = shown.select(*keep, *read, *matched, F.expr(index.keys()).alias("__keys"))
    # The outer form: for the other one a filter on the keys is inferred, pushed down, and computes them again.
    if not matched:
        return indexed_hits(index, shown.select("*", F.explode_outer("__keys").alias("__key")), keep)
    named = "named_struct('id', CAST({} AS STRING), 'key', CAST({} AS BIGINT))"
    each = f"transform({parts}, r -> {named.format('r', 'NULL')})"
    both = f"concat(transform(__keys, k -> {named.format('NULL', 'k')}), CASE WHEN {some} THEN {each} ELSE array() END)"
    shown = shown.select(*keep, *read, "__keys", F.expr(f"explode_outer({both})").alias("__c"))
    return indexed_hits(index, shown.select(*keep, *read, "__keys", F.col("__c.id").alias("__id"), F.col("__c.key").alias("__key")), keep)


# --- findings -----------------------------------------------------------------------------------


def correlation_uid(data: Column, event_id: Column) -> Column:
    return F.coalesce(strict_string(get(data, "metadata", "uid")), event_id)


def event_time(data: Column, metadata: Column) -> Column:
    """Time of an event: that of `data.time` as the stored event has it, else the collector's ingest
    time, else now. Never NULL, so every finding lies in some time range."""
    time = get(data, "time")
    stamp = strict_string(F.try_element_at(metadata, F.lit("timestamp")))
    return F.coalesce(epoch_time(time, kind(time)), F.try_to_timestamp(stamp), F.current_timestamp())


RULE_DIM = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("__title", T.StringType()),
        T.StructField("__level", T.StringType()),
    ]
)


def build_findings(hits: DataFrame, rules: Iterable[Rule], keep: list[str] | None = None) -> DataFrame:
    """Findings of hits with columns event_id, rule_id, time, correlation_uid (and `keep`, and observables if there).

    `metadata.uid` is the event's id, shared by all its findings; `finding_info.uid` is unique.
    """
    rows = [(r.id, r.title, r.level) for r in rules]
    dim = hits.sparkSession.createDataFrame(rows, RULE_DIM)
    if sum(len(text or "") + 20 for row in rows for text in row) <= BROADCAST_CHARACTERS:
        dim = F.broadcast(dim)
    product = F.struct(
        F.lit(PRODUCT_NAME).alias("vendor_name"), F.lit(PRODUCT_NAME).alias("product_name")
    )
    return hits.join(dim, "rule_id").select(
        F.lit(FINDING_CLASS_UID).alias("class_uid"),
        "time",
        F.col("__level").alias("severity"),
        "rule_id",
        (F.col("observables") if "observables" in hits.columns else F.lit(None).cast("string")).alias("observables"),
        F.struct(
            F.sha2(F.concat_ws("\u0001", "event_id", "rule_id"), 256).alias("uid"),
            F.col("__title").alias("title"),
        ).alias("finding_info"),
        F.struct(
            F.col("event_id").alias("uid"),
            F.col("correlation_uid").alias("correlation_uid"),
            product.alias("product"),
        ).alias("metadata"),
        *(keep or []),
    )


def observed(body: Column, names: Iterable[str]) -> Column:
    """The named fields of an event as JSON text, those that it has; NULL when it has none of them."""
    pairs = [x for n in names for x in (F.lit(n), get(body, *n.split("."), to="string"))]
    if not pairs:
        return F.lit(None).cast("string")
    known = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
    return F.when(F.size(known) > 0, F.to_json(known))


def detect(
    events: DataFrame,
    rules: Iterable[Rule],
    strategy: str = "auto",
    keep_metadata: bool = False,
    observe: Iterable[str] = (),
) -> DataFrame:
    """Findings of events with VARIANT data; with `keep_metadata` also their `event_metadata`.

    `observe` names fields whose values a finding keeps as its observables, for correlations above all.
    """
    rules = list(rules)
    data, meta = F.col("data"), F.col("metadata")
    full = events.withColumns(
        {
            "time": event_time(data, meta),
            "correlation_uid": correlation_uid(data, F.col("event_id")),
            "observables": observed(detection_body(data, meta), list(observe)),
        }
    )
    keep = ["event_id", "time", "correlation_uid", "observables"]
    if keep_metadata:
        full = full.withColumn("event_metadata", meta)
        keep.append("event_metadata")
    hits = match_rules(prepare_events(full), rules, keep, strategy)
    return build_findings(hits, rules, ["event_metadata"] if keep_metadata else None)


def findings_as_events(findings: DataFrame) -> DataFrame:
    """Findings with `event_metadata` as events of their own; they inherit the event's metadata."""
    body = [c for c in findings.columns if c != "event_metadata"]
    yes = variant_of(F.lit(True))
    return findings.select(
        F.col("finding_info.uid").alias("event_id"),
        F.to_variant_object(F.struct(*body)).alias("data"),
        with_entries(F.col("event_metadata"), ocsf=yes, eventlake=yes).alias("metadata"),
    )
