"""What every match of a regular expression must hold, read off the pattern."""

from __future__ import annotations

import re

# Pieces of a pattern; anything that is not understood ends the search with what is certain so far.
_PIECE = re.compile(
    r"""\\Q(?P<quoted>.*?)(?:\\E|\Z)
    | \\(?P<escaped>[^A-Za-z0-9])
    | \\(?P<control>[tnrf])
    | (?P<klass>\\[dDwWsSbBAzZGhHvVRX] | \\[pP](?:\{[^}]*\}|.) | \\x[0-9A-Fa-f]{2} | \\u[0-9A-Fa-f]{4} | \[ | \. | \^ | \$)
    | (?P<open>\((?:\?(?:[:>]|<(?![=!])[A-Za-z0-9]+>|(?P<flags>[a-zA-Z-]+)(?P<scope>[:)])|(?P<look><?[=!])))?)
    | (?P<close>\))
    | (?P<either>\|)
    | (?P<letter>[^\\()\[\]{}|?*+.^$])
    """,
    re.X | re.S,
)
_TIMES = re.compile(r"(?:([?*+])|\{(\d+)(?:,\d*)?\})[?+]?")
_CONTROL = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


class _Unclear(ValueError):
    """The pattern holds something whose meaning is not followed."""


def _class_end(pattern: str, at: int) -> int:
    """End of a character class that begins at `at`; classes may nest."""
    depth, i = 0, at
    while i < len(pattern):
        if pattern.startswith("\\Q", i):
            i = pattern.find("\\E", i) + 2 if "\\E" in pattern[i:] else len(pattern)
            continue
        if pattern[i] == "\\":
            i += 2
            continue
        depth += {"[": 1, "]": -1}.get(pattern[i], 0)
        if pattern.startswith(("[]", "[^]"), i):  # a member, or the end?
            raise _Unclear(pattern)
        i += 1
        if depth == 0:
            return i
    raise _Unclear(pattern)


def _sequence(pattern: str, at: int, depth: int) -> tuple[list[list[str]], int]:
    """(runs of each alternative, end) of a group's inside that begins at `at`."""
    branches: list[list[str]] = []
    runs, run = [], ""

    def cut() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while at < len(pattern):
        match = _PIECE.match(pattern, at)
        if not match:
            raise _Unclear(pattern)
        kind = next(k for k in ("quoted", "escaped", "control", "klass", "open", "close", "either", "letter") if match.group(k) is not None)
        at = match.end()
        if kind == "close":
            if not depth:
                raise _Unclear(pattern)
            cut()
            return [*branches, runs], at
        if kind == "either":
            cut()
            branches.append(runs)
            runs = []
            continue
        inner: list[str] = []
        literal = ""
        if kind == "open":
            flags, scope = match.group("flags"), match.group("scope")
            if flags and ("x" in flags or "u" in flags or "d" in flags):
                raise _Unclear(pattern)  # spaces would not count
            if scope == ")":
                continue
            cut()
            inside, at = _sequence(pattern, at, depth + 1)
            if not match.group("look") and len(inside) == 1:
                inner = inside[0]
        elif kind == "klass":
            if match.group(0) == "[":
                at = _class_end(pattern, match.start())
            cut()
        else:
            literal = match.group(kind) if kind != "control" else _CONTROL[match.group(kind)]
        times = _TIMES.match(pattern, at)
        if times:
            at = times.end()
        if not times:
            run += literal
            runs += inner
            continue
        needed = times.group(1) == "+" or (times.group(2) is not None and int(times.group(2)) > 0)
        # Only the last character of a literal is repeated; after it a new run begins.
        run += literal if needed else literal[:-1]
        cut()
        if needed:
            runs += inner
    if depth:
        raise _Unclear(pattern)
    cut()
    return [*branches, runs], at


def required_runs(pattern: str) -> list[str]:
    """Texts that every match of the pattern holds, up to case; none when that is not certain.

    Groups without alternatives count, those with alternatives, classes, references, lookarounds and what may
    be missing do not. Quantified parts end a run.
    """
    try:
        branches, _ = _sequence(pattern, 0, 0)
    except (_Unclear, IndexError):
        return []
    return branches[0] if len(branches) == 1 else []
