"""Rules to boolean Spark SQL text.

Boolean structure and precedence are left to Spark's own expression parser: a condition keeps its
words and parentheses, only the selection names are replaced by their predicates.
"""

from __future__ import annotations

import base64
import fnmatch
import ipaddress
import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from eventlake.functions.net import ipv4_number, ipv6_hex
from eventlake.functions.variants import json_path
from eventlake.operators.rules import Rule, RuleError

# Characters that introduce a command-line switch.
DASHES = ("-", "/", "–", "—", "―")
# Fixed values: (leading, trailing) characters of a Base64 text that depend on its neighbours,
# by the offset of the text within a three-byte group.
BASE64_TRIM = {0: (0, (0, 3, 2)), 1: (2, (0, 3, 2)), 2: (3, (0, 3, 2))}

# Modifiers of the public rule format.
MODIFIERS = {
    "contains", "startswith", "endswith", "all", "re", "i", "m", "s", "cased", "cidr",
    "lt", "lte", "gt", "gte", "exists", "fieldref",
    "base64", "base64offset", "wide", "utf16le", "utf16be", "utf16", "windash",
}
EQUALS = "{t} = {v}"
COMPARE = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
# A plain decimal number: the cast alone also takes NaN, Infinity and Java's type suffixes.
NUMBER_TEXT = r"r'^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$'"
KEYWORD_LEAVES = r'"[^"\\]*+(?:\\.[^"\\]*+)*+":|"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Constants:
    """Constants taken out of a rule's predicate: lists of texts, and numbers, in columns of its row."""

    texts: list[list[str]] = field(default_factory=list)
    numbers: list[float] = field(default_factory=list)

    def text(self, values: list[str]) -> str:
        self.texts.append(values)
        return f"__c[{len(self.texts) - 1}]"

    def number(self, value: float) -> str:
        self.numbers.append(value)
        return f"__n[{len(self.numbers) - 1}]"


@dataclass
class Fields:
    """Rule fields as extracted columns: each path is read once, however many rules name it.

    While `constants` is set, predicates name its columns in place of a rule's texts and numbers: what is
    left is the rule's shape, the same for all rules that differ in them only.
    """

    prefix: str = "f"
    names: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    regexes: set[str] = field(default_factory=set)
    constants: Constants | None = None

    def literal(self, value: str) -> str:
        return sql_text(value) if self.constants is None else self.constants.text([value]) + "[0]"

    def numeral(self, value: float) -> str:
        return f"{value!r}D" if self.constants is None else self.constants.number(value)

    def any_of(self, options: list[tuple[str, str | None]]) -> Callable[[str], str]:
        """Predicate that holds for one of the options: (text with {t} for the value and {v} for a constant, the constant)."""
        groups: dict[str, list[str | None]] = {}
        for call, constant in options:
            groups.setdefault(call, []).append(constant)
        parts = []
        for call, constants in groups.items():
            known = list(dict.fromkeys(c for c in constants if c is not None))
            if not known:
                parts.append((call, ""))
            elif len(known) == 1:
                parts.append((call, self.literal(known[0])))
            elif self.constants is not None:
                each = "array_contains({v}, {t})" if call == EQUALS else f"exists({{v}}, v -> {call.replace('{v}', 'v')})"
                parts.append((each, self.constants.text(known)))
            elif call == EQUALS:
                parts.append(("{t} IN ({v})", ", ".join(sql_text(k) for k in known)))
            else:
                parts += [(call, sql_text(k)) for k in known]
        return lambda t: "(" + " OR ".join(c.replace("{t}", t).replace("{v}", v) for c, v in parts) + ")"

    def _slot(self, name: str) -> str:
        return self.names.setdefault(name, f"__{self.prefix}{len(self.names)}")

    def _column(self, suffix: str, name: str, sql: str) -> str:
        column = self._slot(name) + suffix
        self.columns.setdefault(column, sql)
        return column

    def text(self, name: str) -> str:
        return self._column("t", name, self.text_sql(name))

    def lowered(self, name: str) -> str:
        return self._column("l", name, f"lower({self.text_sql(name)})")

    def number(self, name: str) -> str:
        return self._column("n", name, self.number_sql(name))

    def present(self, name: str) -> str:
        return self._column("e", name, self.present_sql(name))

    def elements(self, name: str) -> str | None:
        """Column holding the elements when the value is an array; None when it cannot be one."""
        sql = self.elements_sql(name)
        return None if sql is None else self._column("a", name, sql)

    def test(self, name: str, predicate: Callable[[str], str], cased: bool = False) -> str:
        """Predicate on the value, or on any element of an array value."""
        value = self.text(name) if cased else self.lowered(name)
        items = self.elements(name)
        if items is None:
            return predicate(value)
        element = "x" if cased else "lower(x)"
        return f"if({items} IS NULL, {predicate(value)}, exists({items}, x -> {predicate(element)}))"

    def number_test(self, name: str, predicate: Callable[[str], str]) -> str:
        """Predicate on the value as a number, which is parsed once per row."""
        items = self.elements(name)
        if items is None:
            return predicate(self.number(name))
        one = f"CASE WHEN x RLIKE {NUMBER_TEXT} THEN try_cast(x AS DOUBLE) END"
        each = f"exists({items}, x -> {predicate(one)})"
        return f"if({items} IS NULL, {predicate(self.number(name))}, {each})"

    def address_test(self, name: str, version: int, low: str, high: str) -> str:
        """The value, or an element, is an address between two SQL values; the value is parsed once per row."""
        parse = ipv4_number if version == 4 else ipv6_hex
        parsed = self._column(f"v{version}", name, f"transform(array({self.text_sql(name)}), t -> {parse('t')})[0]")
        one = f"{parsed} BETWEEN {low} AND {high}"
        items = self.elements(name)
        if items is None:
            return one
        return f"if({items} IS NULL, {one}, exists({items}, x -> ({parse('x')}) BETWEEN {low} AND {high}))"

    def numbers(self, name: str) -> str:
        """Array of the values that are numbers, NULLs among them."""
        items = self.elements(name)
        alone = f"array({self.number(name)})"
        if items is None:
            return alone
        return f"if({items} IS NULL, {alone}, transform({items}, x -> CASE WHEN x RLIKE {NUMBER_TEXT} THEN try_cast(x AS DOUBLE) END))"

    def number_sql(self, name: str) -> str:
        text = self.text_sql(name)
        return f"CASE WHEN {text} RLIKE {NUMBER_TEXT} THEN try_cast({text} AS DOUBLE) END"

    # Supplied by the kind of table.
    def text_sql(self, name: str) -> str:
        raise NotImplementedError

    def present_sql(self, name: str) -> str:
        raise NotImplementedError

    def elements_sql(self, name: str) -> str | None:
        raise NotImplementedError

    def keyword_test(self, predicate: Callable[[str], str]) -> str:
        """Predicate on any text value of the event."""
        raise NotImplementedError

    def keyword_texts(self) -> str:
        """Array of all text values of the event, in lower case."""
        raise NotImplementedError

    def spell_keyword(self, text: str) -> str:
        return text


@dataclass
class BodyFields(Fields):
    """Fields of a VARIANT column."""

    body: str = "__body"

    def _get(self, name: str, to: str) -> str:
        return f"try_variant_get({self.body}, {sql_text(json_path(*name.split('.')))}, '{to}')"

    def text_sql(self, name: str) -> str:
        return self._get(name, "string")

    def present_sql(self, name: str) -> str:
        return f"{self._get(name, 'variant')} IS NOT NULL"

    def elements_sql(self, name: str) -> str:
        keys = name.split(".")
        options = [self._get(name, "array<string>")]
        for cut in range(1, len(keys)):
            outer = self._get(".".join(keys[:cut]), "array<variant>")
            inner = sql_text(json_path(*keys[cut:]))
            options.append(f"transform({outer}, v -> try_variant_get(v, {inner}, 'string'))")
        return options[0] if len(options) == 1 else f"coalesce({', '.join(options)})"

    def keyword_texts(self) -> str:
        return self._column(
            "k",
            "",
            f"transform(regexp_extract_all(to_json({self.body}), {sql_text(KEYWORD_LEAVES)}, 1), "
            "x -> lower(x))",
        )

    def keyword_test(self, predicate: Callable[[str], str]) -> str:
        return f"exists({self.keyword_texts()}, x -> {predicate('x')})"

    def spell_keyword(self, text: str) -> str:
        return json.dumps(text, ensure_ascii=False)[1:-1]  # leaves keep their JSON spelling


@dataclass
class TableFields(Fields):
    """Fields of a table with declared columns: only the named columns are read from the files."""

    schema: T.StructType = field(default_factory=T.StructType)

    def _find(self, name: str) -> tuple[str | None, T.DataType | None]:
        dtype: T.DataType = self.schema
        parts = []
        for key in name.split("."):
            if not isinstance(dtype, T.StructType) or key not in dtype.fieldNames():
                return None, None
            dtype = dtype[key].dataType
            parts.append(f"`{key}`")
        return ".".join(parts), dtype

    def text_sql(self, name: str) -> str:
        column, dtype = self._find(name)
        if column is None or isinstance(dtype, T.ArrayType):
            return "CAST(NULL AS STRING)"
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return f"regexp_replace(CAST({column} AS STRING), '[.]0$', '')"
        return column if isinstance(dtype, T.StringType) else f"CAST({column} AS STRING)"

    def number_sql(self, name: str) -> str:
        column, dtype = self._find(name)
        if isinstance(dtype, T.NumericType):
            return f"nullif(CAST({column} AS DOUBLE), double('NaN'))"
        return super().number_sql(name)

    def present_sql(self, name: str) -> str:
        column, _ = self._find(name)
        return "false" if column is None else f"{column} IS NOT NULL"

    def elements_sql(self, name: str) -> str | None:
        column, dtype = self._find(name)
        if isinstance(dtype, T.ArrayType):
            return f"CAST({column} AS ARRAY<STRING>)"
        return None

    def keyword_test(self, predicate: Callable[[str], str]) -> str:
        return "(" + (" OR ".join(predicate(self.lowered(n)) for n in self._texts()) or "false") + ")"

    def keyword_texts(self) -> str:
        return f"array_compact(array({', '.join(map(self.lowered, self._texts()))}))"

    def _texts(self) -> list[str]:
        return [f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType)]


# --- values -------------------------------------------------------------------------------------


def split_wildcards(value: str) -> list[tuple[str, str]]:
    """('x', literal), ('*', '') and ('?', '') pieces. A backslash escapes *, ? and itself."""
    pieces = []
    for escaped, mark, literal in re.findall(r"\\([*?\\])|([*?])|([^*?\\]+|\\)", value):
        kind, text = (mark, "") if mark else ("x", escaped or literal)
        if kind == "x" and pieces and pieces[-1][0] == "x":
            text = pieces.pop()[1] + text
        pieces.append((kind, text))
    return pieces


def literal_pieces(value: str, where: str, literal: bool) -> list[tuple[str, str]]:
    pieces = ([("x", value)] if value else []) if literal else split_wildcards(value)
    if where in ("contains", "endswith"):
        pieces = [("*", ""), *pieces]
    if where in ("contains", "startswith"):
        pieces = [*pieces, ("*", "")]
    return pieces


def _text_match(
    value: str,
    where: str,
    cased: bool,
    literal: bool,
    spell: Callable[[str], str] = lambda text: text,
) -> tuple[str, str | None]:
    """Option for a string value, see `any_of`; `where` is equals, contains, startswith or endswith."""
    pieces = literal_pieces(value, where, literal)
    shape = re.sub(r"\*+", "*", "".join(kind for kind, _ in pieces))
    texts = [spell(text if cased else text.lower()) for kind, text in pieces if kind == "x"]
    if shape in ("", "*"):
        return "{t} IS NOT NULL" if shape else "{t} = ''", None
    calls = {
        "x": EQUALS,
        "*x*": "contains({t}, {v})",
        "x*": "startswith({t}, {v})",
        "*x": "endswith({t}, {v})",
    }
    if shape in calls:
        return calls[shape], texts[0]
    marks = {"*": "%", "?": "_"}
    parts = iter(texts)
    pattern = "".join(
        marks[c] if c in marks else re.sub(r"([%_\\])", r"\\\1", next(parts)) for c in shape
    )
    return "{t} LIKE {v}", pattern


def _with_dashes(value: str) -> list[str]:
    """Every spelling of the switches in a command line."""
    pieces = re.split(r"((?:^|(?<=\s))[-/–—―](?=\S))", value)
    choices = [DASHES if i % 2 else (piece,) for i, piece in enumerate(pieces)]
    return ["".join(combo) for combo in itertools.product(*choices)]


def _encoded(value: bytes, shifted: bool) -> list[str]:
    if not shifted:
        return [base64.b64encode(value).decode()]
    out = []
    for offset, (start, tails) in BASE64_TRIM.items():
        text = base64.b64encode(b" " * offset + value).decode()
        tail = tails[(len(value) + offset) % 3]
        out.append(text[start : len(text) - tail])
    return out


def _transformed(value: str, mods: list[str]) -> tuple[list[str], bool]:
    """(values after the encoding modifiers, whether they are literal text)."""
    values: list[str | bytes] = [value]
    literal = False
    for mod in mods:
        if mod == "windash":
            values = [w for v in values for w in _with_dashes(v)]
        elif mod in ("wide", "utf16le", "utf16be", "utf16"):
            codec = {"utf16be": "utf-16-be", "utf16": "utf-16"}.get(mod, "utf-16-le")
            values = [v.encode(codec) for v in values]
            literal = True
        elif mod in ("base64", "base64offset"):
            raw = [v if isinstance(v, bytes) else v.encode() for v in values]
            values = [e for v in raw for e in _encoded(v, mod == "base64offset")]
            literal = True
    if any(isinstance(v, bytes) for v in values):
        values = [v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in values]
    return values, literal


def field_test(fields: Fields, key: str, value: Any) -> str:
    """Predicate of one `field|modifiers: value` entry."""
    name, *mods = key.split("|")
    unknown = [m for m in mods if m not in MODIFIERS]
    if unknown:
        raise RuleError(f"unknown modifier {unknown[0]!r} in {key!r}")
    values = value if isinstance(value, list) else [value]
    if not values:
        raise RuleError(f"no values for {key!r}")
    cased = "cased" in mods
    where = next((m for m in ("contains", "startswith", "endswith") if m in mods), "equals")

    if "exists" in mods:
        return fields.present(name) if bool(values[0]) else f"NOT ({fields.present(name)})"

    joined = " AND " if "all" in mods else " OR "
    tests: list[str] = []
    anywhere: list[tuple[str, str | None]] = []  # tested together, on one value
    for v in values:
        if v is None:
            items = fields.elements(name)
            tests.append(f"{fields.text(name)} IS NULL" + (f" AND {items} IS NULL" if items else ""))
        elif "re" in mods:
            flags = "".join(m for m in ("i", "m", "s") if m in mods)
            pattern = (f"(?{flags})" if flags else "") + str(v)
            fields.regexes.add(pattern)
            text = fields.literal(pattern)
            tests.append(fields.test(name, lambda t, p=text: f"{t} RLIKE {p}", True))
        elif "cidr" in mods:
            try:
                net = ipaddress.ip_network(str(v), strict=False)
            except ValueError as exc:
                raise RuleError(f"bad network {v!r} in {key!r}") from exc
            ends = [int(net.network_address), int(net.broadcast_address)]
            low, high = [fields.numeral(float(e)) if net.version == 4 else fields.literal(f"{e:032x}") for e in ends]
            tests.append(fields.address_test(name, net.version, low, high))
        elif any(m in COMPARE for m in mods):
            op = next(COMPARE[m] for m in mods if m in COMPARE)
            try:
                number = fields.numeral(float(v))
            except (TypeError, ValueError) as exc:
                raise RuleError(f"{key!r} needs a number, not {v!r}") from exc
            tests.append(fields.number_test(name, lambda n, x=number: f"{n} {op} {x}"))
        elif "fieldref" in mods:
            other = fields.text(str(v)) if cased else fields.lowered(str(v))
            call = {"equals": "{t} = {o}"}.get(where, where + "({t}, {o})")
            tests.append(fields.test(name, lambda t, o=other: call.format(t=t, o=o), cased))
        else:
            options = _options(v, mods, where, cased)
            if "all" in mods:
                tests.append(fields.test(name, fields.any_of(options), cased))
            else:
                anywhere += options
    if anywhere:
        tests.append(fields.test(name, fields.any_of(anywhere), cased))
    return "(" + joined.join(f"({t})" for t in tests) + ")"


def spellings(value: Any, mods: list[str]) -> tuple[list[str], bool]:
    """(spellings of a text value after its modifiers, whether they are literal text)."""
    text = str(value).lower() if isinstance(value, bool) else str(value)
    texts, literal = _transformed(text, mods)
    return texts, literal or not isinstance(value, str)


def _options(value: Any, mods: list[str], where: str, cased: bool) -> list[tuple[str, str | None]]:
    texts, literal = spellings(value, mods)
    return [_text_match(t, where, cased, literal) for t in texts]


def selection_test(fields: Fields, body: Any) -> str:
    """Map: all entries. List of maps: any of them. List of words: any word in any text value."""
    if isinstance(body, dict):
        parts = []
        for key, value in body.items():
            name, _, mods = key.partition("|")
            parts.append(
                _keyword_test(fields, value, "all" in mods.split("|"))
                if not name
                else field_test(fields, key, value)
            )
        if not parts:
            raise RuleError("empty selection")
        return "(" + " AND ".join(parts) + ")"
    if isinstance(body, list) and body:
        maps = [selection_test(fields, m) for m in body if isinstance(m, dict)]
        words = [w for w in body if not isinstance(w, dict)]
        if words:
            maps.append(_keyword_test(fields, words, False))
        return "(" + " OR ".join(maps) + ")"
    if isinstance(body, str):
        return _keyword_test(fields, [body], False)
    raise RuleError(f"unusable selection {body!r}")


def _keyword_test(fields: Fields, words: Any, every: bool) -> str:
    words = words if isinstance(words, list) else [words]
    options = [_text_match(str(w), "contains", False, False, fields.spell_keyword) for w in words]
    if not every:
        return fields.keyword_test(fields.any_of(options))
    return "(" + " AND ".join(fields.keyword_test(fields.any_of([o])) for o in options) + ")"


CONDITION = re.compile(r"(?i)\b(all|any|\d+)\s+of\s+([\w*.-]+)|[\w.-]+")


def named_selections(selections: dict, pattern: str) -> list[str]:
    """Names of the selections that `1 of pattern` and its like mean."""
    if pattern.lower() == "them":
        return [n for n in selections if not n.startswith("_")]
    return [n for n in selections if fnmatch.fnmatchcase(n, pattern)]


def condition_test(fields: Fields, detection: dict) -> str:
    """Predicate of a whole detection section."""
    selections = {k: v for k, v in detection.items() if k not in ("condition", "timeframe")}
    compiled: dict[str, str] = {}

    def one(name: str) -> str:
        if name not in selections:
            raise RuleError(f"condition names unknown selection {name!r}")
        if name not in compiled:
            compiled[name] = f"coalesce({selection_test(fields, selections[name])}, false)"
        return compiled[name]

    def group(count: str, pattern: str) -> str:
        names = named_selections(selections, pattern)
        if not names:
            raise RuleError(f"no selection matches {pattern!r}")
        if count.lower() == "all":
            return "(" + " AND ".join(one(n) for n in names) + ")"
        if count.lower() in ("any", "1"):
            return "(" + " OR ".join(one(n) for n in names) + ")"
        return "((" + " + ".join(f"CAST({one(n)} AS INT)" for n in names) + f") >= {int(count)})"

    def part(match: re.Match) -> str:
        if match.group(1):
            return group(match.group(1), match.group(2))
        word = match.group(0)
        return word.upper() if word.lower() in ("and", "or", "not") else one(word)

    conditions = detection["condition"]
    texts = []
    for condition in conditions if isinstance(conditions, list) else [conditions]:
        rest = CONDITION.sub("", condition)
        if rest.strip("() \t\r\n"):
            raise RuleError(f"unsupported condition {condition!r}")
        texts.append("(" + CONDITION.sub(part, condition) + ")")
    return " OR ".join(texts)


def rule_test(fields: Fields, rule: Rule) -> str:
    """Two-valued predicate of a rule, without its logsource."""
    try:
        return condition_test(fields, rule.detection)
    except RuleError as exc:
        raise RuleError(f"rule {rule.id}: {exc}") from exc
