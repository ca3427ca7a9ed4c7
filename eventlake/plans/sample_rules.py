"""Sample rules over the given events, and their predicates in SQL for the comparison."""

from __future__ import annotations

from eventlake.operators.rules import Rule, rule_from_dict

_DOCS = [
    (
        "Costly error", "high",
        {"sel": {"event_type": "ERROR", "value|gte": 100}, "condition": "sel"},
        "event_type = 'error' AND value >= 100",
    ),
    (
        "Very large purchase", "critical",
        {"sel": {"event_type": "purchase", "value|gt": 200}, "condition": "sel"},
        "event_type = 'purchase' AND value > 200",
    ),
    (
        "Signup with a low key", "low",
        {"sel": {"event_type": "signup", "k|lt": 5}, "condition": "sel"},
        "event_type = 'signup' AND k < 5",
    ),
    (
        "Click on a watched key", "informational",
        {"sel": {"event_type": "click", "k": [1, 2, 3]}, "condition": "sel"},
        "event_type = 'click' AND k IN (1, 2, 3)",
    ),
    (
        "View by an early user", "medium",
        {"sel": {"event_type": "V?ew", "user_id|lte": 20}, "condition": "sel"},
        "event_type LIKE 'v_ew' AND user_id <= 20",
    ),
    (
        "Cheap click", None,
        {"sel": {"event_type|startswith": "cl", "value|lt": 1}, "condition": "sel"},
        "event_type LIKE 'cl%' AND value < 1",
    ),
    (
        "Error outside the usual keys", "medium",
        {"sel": {"event_type": "error"}, "usual": {"k|gte": 10}, "condition": "sel and not usual"},
        "event_type = 'error' AND NOT k >= 10",
    ),
    (
        "Any of two oddities", "low",
        {
            "odd_key": {"k": 42},
            "odd_value": {"value|gt": 300},
            "view": {"event_type": "view"},
            "condition": "1 of odd_* and not view",
        },
        "(k = 42 OR value > 300) AND event_type <> 'view'",
    ),
    (
        "Severe event of the first source", "high",
        {"sel": {"source_id": "SRC-0", "severity": "High"}, "condition": "all of them"},
        "source_id = 'src-0' AND severity = 'high'",
    ),
    (
        "Props name the answer", "informational",
        {"sel": {"props|contains|all": ["k", "4", "2"]}, "condition": "sel"},
        "contains(props, 'k') AND contains(props, '4') AND contains(props, '2')",
    ),
]

EVENT_RULES: list[Rule] = [
    rule_from_dict({"id": f"r{i}", "title": title, "level": level, "detection": body})
    for i, (title, level, body, _) in enumerate(_DOCS)
]


def _text(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


# hits(event_id, rule_id, title, level, ...) over the adapter's `ev`.
HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT ev.*, 'r{i}' AS rule_id, {_text(title)} AS title, {_text(level)} AS level FROM ev WHERE {sql}"
    for i, (title, level, _, sql) in enumerate(_DOCS)
) + ")"


def equality_rules(count: int) -> list[Rule]:
    """Rules naming one kind of event and one user each: only their number matters."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return [
        rule_from_dict(
            {
                "id": f"q{i}",
                "title": f"Watched user {i}",
                "level": "low",
                "detection": {"sel": {"event_type": kinds[i % 5], "user_id": i // 5}, "condition": "sel"},
            }
        )
        for i in range(count)
    ]


def threshold_rules(count: int) -> list[Rule]:
    """Rules that need a predicate each: a kind of event with a value above a bound of its own."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return [
        rule_from_dict(
            {
                "id": f"t{i}",
                "title": f"Bound {i}",
                "level": "low",
                "detection": {
                    "sel": {"event_type": kinds[i % 5], "value|gt": 100 + i, "props|contains": str(i % 10)},
                    "condition": "sel",
                },
            }
        )
        for i in range(count)
    ]
