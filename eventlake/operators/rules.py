"""Detection rules: loading, the rule table, and its set operations."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # rule files can then only be JSON
    yaml = None

RULE_SCHEMA = (
    "id string, title string, description string, enabled boolean, level string, "
    "logsource struct<product:string,service:string,category:string>, "
    "author string, tags array<string>, body string"
)


class RuleError(ValueError):
    """A rule that cannot be loaded or compiled."""


@dataclass(frozen=True)
class Rule:
    id: str
    title: str | None
    detection: dict
    description: str | None = None
    enabled: bool = True
    level: str | None = None
    product: str | None = None
    service: str | None = None
    category: str | None = None
    author: str | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)

    @property
    def logsource(self) -> tuple[str | None, str | None, str | None]:
        return (self.product, self.service, self.category)


def rule_from_dict(doc: dict) -> Rule:
    """A rule document; without `id` the id derives from the content."""
    if not isinstance(doc, dict) or not isinstance(doc.get("detection"), dict):
        raise RuleError(f"rule without a detection section: {str(doc)[:80]}")
    if "condition" not in doc["detection"]:
        raise RuleError(f"rule without a condition: {doc.get('title')}")
    source = doc.get("logsource") or {}
    text = json.dumps(doc, sort_keys=True, default=str)
    ident = str(doc.get("id") or hashlib.sha256(text.encode()).hexdigest()[:32])
    if "\u0001" in ident:
        raise RuleError("control character in a rule id")
    return Rule(
        id=ident,
        title=doc.get("title"),
        detection=doc["detection"],
        description=doc.get("description"),
        enabled=bool(doc.get("enabled", True)),
        level=doc.get("level"),
        product=source.get("product"),
        service=source.get("service"),
        category=source.get("category"),
        author=doc.get("author"),
        tags=tuple(doc.get("tags") or ()),
    )


def documents_of(text: str) -> list:
    """The documents of a rule file."""
    try:
        return [d for d in yaml.safe_load_all(text) if d is not None] if yaml else [json.loads(text)]
    except Exception as exc:
        raise RuleError(f"unreadable rule: {exc}") from exc


def rule_from_text(text: str) -> Rule:
    """The rule of a file with one document."""
    docs = documents_of(text)
    if len(docs) != 1:
        raise RuleError(f"{len(docs)} documents where one rule was expected")
    return rule_from_dict(docs[0])


def load_documents(paths: str | Iterable[str]) -> list[tuple[str, dict]]:
    """(file, document) of all rule files of one or more folders, recursively."""
    suffixes = (".yaml", ".yml", ".json") if yaml else (".json",)
    found = []
    for root in [paths] if isinstance(paths, str) else paths:
        if not os.path.isdir(root):
            raise RuleError(f"no such folder: {root}")
        files = sorted(
            os.path.join(folder, name)
            for folder, _, names in os.walk(root)
            for name in names
            if name.endswith(suffixes)
        )
        for path in files:
            with open(path, encoding="utf-8") as handle:
                found += [(path, doc) for doc in documents_of(handle.read())]
    return found


def load_rules(paths: str | Iterable[str]) -> list[Rule]:
    """Rules of one or more folders, recursively; correlation documents are left to `load_correlations`.

    Any unreadable rule or repeated id is an error.
    """
    rules: dict[str, Rule] = {}
    for path, doc in load_documents(paths):
        if isinstance(doc, dict) and "correlation" in doc:
            continue
        rule = rule_from_dict(doc)
        if rule.id in rules:
            raise RuleError(f"rule id {rule.id} is used twice ({path})")
        rules[rule.id] = rule
    return list(rules.values())


def set_enabled(rules: Iterable[Rule], rule_id: str, enabled: bool) -> list[Rule]:
    changed = [replace(r, enabled=enabled) if r.id == rule_id else r for r in rules]
    if not any(r.id == rule_id for r in changed):
        raise KeyError(f"no rule {rule_id}")
    return changed


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """One row per rule; `body` holds the detection section as JSON text."""
    rows = [
        (
            r.id,
            r.title,
            r.description,
            r.enabled,
            r.level,
            r.logsource,
            r.author,
            list(r.tags),
            json.dumps(r.detection, default=str),
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_of_table(table: DataFrame) -> list[Rule]:
    """Read the rule table back. Rules are compiled on the driver, so they all pass through it."""
    return [
        Rule(
            id=row.id,
            title=row.title,
            detection=json.loads(row.body),
            description=row.description,
            enabled=row.enabled,
            level=row.level,
            product=row.logsource.product,
            service=row.logsource.service,
            category=row.logsource.category,
            author=row.author,
            tags=tuple(row.tags or ()),
        )
        for row in table.orderBy("id").toLocalIterator()
    ]


def merge_rules(table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the new rules, conflicts): a rule whose id exists is refused.

    Of several new rules with one id the first by all columns is taken, the others are conflicts; so
    is a rule without an id.
    """
    order = Window.partitionBy("id").orderBy(*new.columns)
    numbered = new.withColumn("__nth", F.row_number().over(order)).join(
        table.select("id", F.lit(True).alias("__known")), "id", "left"
    )
    fresh = F.coalesce(F.col("__nth") == 1, F.lit(False)) & F.col("__known").isNull() & F.col("id").isNotNull()
    return (
        table.unionByName(numbered.where(fresh).select(*new.columns)),
        numbered.where(~fresh).select(*new.columns),
    )


def switch_rules(table: DataFrame, rule_ids: list[str], enabled: bool) -> DataFrame:
    flag = F.when(F.col("id").isin(rule_ids), F.lit(enabled)).otherwise(F.col("enabled"))
    return table.withColumn("enabled", flag)


def list_rules(table: DataFrame) -> DataFrame:
    """Summary of each rule; rules lacking a part are left out."""
    parts = ["id", "title", "description", "level", "logsource"]
    complete = " AND ".join(f"{p} IS NOT NULL" for p in parts)
    return table.where(complete).select(
        "id",
        "title",
        "description",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "level",
        "logsource",
    )


def get_rule(table: DataFrame, rule_id: str) -> DataFrame:
    return table.where(F.col("id") == rule_id)


def _holds(column: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(needle)), F.lit(False))


def filter_rules(
    table: DataFrame,
    category: str | None = None,
    product: str | None = None,
    service: str | None = None,
    levels: list[str] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Exact logsource parts, level in a set (no level passes), text in title, description, tags or author."""
    for part, wanted in (("category", category), ("product", product), ("service", service)):
        if wanted:
            table = table.where(F.col(f"logsource.{part}") == wanted)
    if levels:
        level = F.coalesce("level", F.lit(""))
        table = table.where((level == "") | level.isin(levels))
    if search:
        needle = search.lower()
        in_tags = F.coalesce(F.exists("tags", lambda t: _holds(t, needle)), F.lit(False))
        table = table.where(
            _holds(F.col("title"), needle)
            | _holds(F.col("description"), needle)
            | _holds(F.col("author"), needle)
            | in_tags
        )
    return table


def rule_facets(table: DataFrame) -> DataFrame:
    """One row: the distinct non-empty categories, products, services and levels, sorted."""

    def values(column: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col(column) != "", F.col(column))))

    return table.agg(
        values("logsource.category").alias("categories"),
        values("logsource.product").alias("products"),
        values("logsource.service").alias("services"),
        values("level").alias("levels"),
    )
