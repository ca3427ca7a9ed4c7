"""Secret scan by one combined deterministic automaton (operator 5).

All rules are compiled together: their regular expressions become one automaton by subset
construction, which is then minimised; its transition arrays are applied to the UTF-8 bytes of a text
in a single pass. Within a state, the attempts of a rule are kept in the order of their starts, so
each rule finds its leftmost matches, each as long as it goes, without overlap. The pass gives ends;
a start is found by the rule's reversed automaton, back to the rule's last match at most.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings
from eventlake.llm.words import column_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` is shorter than `least` are dropped after they were made."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The base rules. Runs of hex digits shorter than 8 are left to the automaton, so that it
# does not report every short run; a run is matched whole or not at all, so this changes no result.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{8,}", 0, 24),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# --- regular expressions to nondeterministic automata -------------------------------------------------


class Nfa:
    """Moves on sets of bytes and free moves; one start, one end."""

    def __init__(self, rule: Rule) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.text, self.at, self.any_case = rule.pattern, 0, rule.any_case
        self.start, self.end = self._choice()
        if self.at != len(self.text):
            raise ValueError(f"rule {rule.kind}: unread rest {self.text[self.at :]!r}")

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        start, end = self._state(), self._state()
        while True:
            first, last = self._sequence()
            self.free[start].append(first)
            self.free[last].append(end)
            if self._peek() != "|":
                return start, end
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        first = last = self._state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self._atom()
            after_atom = self.at
            low, high = self._times()
            parts = [(a, b)]
            resume = self.at
            for _ in range(1, max(low, high or low + 1, 1)):
                self.at = begin  # once more
                parts.append(self._atom())
            self.at = max(resume, after_atom)
            ends = []
            for i, (x, y) in enumerate(parts):
                if i >= low:
                    ends.append(last)
                self.free[last].append(x)
                last = y
            if high is None:
                self.free[last].append(parts[-1][0])
            end = self._state()
            for state in [*ends, last]:
                self.free[state].append(end)
            last = end
        return first, last

    def _times(self) -> tuple[int, int | None]:
        found = re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}").match(self.text, self.at)
        if not found:
            return 1, 1
        self.at = found.end()
        simple = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(found[0])
        if simple:
            return simple
        return int(found[1]), int(found[3]) if found[3] else None if found[2] else int(found[1])

    def _atom(self) -> tuple[int, int]:
        char = self._peek()
        if char == "(":
            self.at += 1
            part = self._choice()
            self.at += 1
            return part
        start, end = self._state(), self._state()
        self.moves[start].append((self._class() if char == "[" else frozenset(self._cases({self._byte()})), end))
        return start, end

    def _byte(self) -> int:
        found = re.compile(r"\\x([0-9a-fA-F]{2})|\\(.)|(.)", re.S).match(self.text, self.at)
        self.at = found.end()
        return int(found[1], 16) if found[1] else ord(found[2] or found[3])

    def _class(self) -> frozenset:
        self.at += 1
        members: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._byte()
            members.update(range(low, high + 1))
        self.at += 1
        return frozenset(self._cases(members))

    def _cases(self, members: set[int]) -> set[int]:
        if not self.any_case:
            return members
        text = "".join(map(chr, members))
        return {ord(c) for c in text + text.lower() + text.upper()}

    def closure(self, states) -> frozenset:
        seen, open_ = set(states), list(states)
        while open_:
            for state in self.free[open_.pop()]:
                if state not in seen:
                    seen.add(state)
                    open_.append(state)
        return frozenset(s for s in seen if self.moves[s] or s == self.end)

    def step(self, states: frozenset, byte: int) -> frozenset:
        return self.closure({t for s in states for members, t in self.moves[s] if byte in members})

    def reversed(self) -> tuple[list[list[tuple[frozenset, int]]], list[list[int]]]:
        moves, free = [[] for _ in self.moves], [[] for _ in self.free]
        for state, (targets, frees) in enumerate(zip(self.moves, self.free)):
            for members, target in targets:
                moves[target].append((members, state))
            for target in frees:
                free[target].append(state)
        return moves, free


def _byte_classes(nfas: list[Nfa]) -> tuple[np.ndarray, list[int]]:
    """Bytes that no rule tells apart share a class; also one byte of each class."""
    sets = list({members for nfa in nfas for moves in nfa.moves for members, _ in moves})
    names: dict[tuple, int] = {}
    of = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)], np.uint8)
    return of, [int(np.flatnonzero(of == c)[0]) for c in range(len(names))]


# --- the combined automaton ---------------------------------------------------------------------------


class Automaton:
    """Transition arrays of all rules: `next[state, class]`, and `ended[state]`, the rules (as bits) whose
    match ended just before the byte that led to the state; `open[state]` are those with a match so far."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules, nfas = rules, [Nfa(r) for r in rules]
        self.classes, members = _byte_classes(nfas)
        fresh = [nfa.closure([nfa.start]) for nfa in nfas]
        if any(nfa.end in f for nfa, f in zip(nfas, fresh)):
            raise ValueError("a rule must not match the empty text")
        idle = tuple((False, ()) for _ in nfas)
        number, rows, ended, open_ = {(idle, 0): 0}, [], [], []
        queue = [(idle, 0)]
        cache: dict = {}
        for state, over in queue:  # grows while it is read
            ended.append(over)
            open_.append(sum(1 << r for r, (pending, _) in enumerate(state) if pending))
            row = []
            for byte in members:
                nexts, finished = [], 0
                for r, part in enumerate(state):
                    key = r, part, byte
                    if key not in cache:
                        cache[key] = _advance(nfas[r], fresh[r], part, byte, rules[r].kind)
                    done, after = cache[key]
                    finished |= done << r
                    nexts.append(after)
                target = tuple(nexts), finished
                if target not in number:
                    number[target] = len(number)
                    queue.append(target)
                row.append(number[target])
            rows.append(row)
        self.next, self.ended, self.open = _minimised(np.array(rows), np.array(ended), np.array(open_))
        self.back = [_reversed(nfa, self.classes, members) for nfa in nfas]

    def rows(self) -> list[list]:
        """The arrays as nested lists: row[byte] is the next row, row[256] what ended, row[257] what is open."""
        rows: list[list] = [[] for _ in self.next]
        for row, nexts, ended, open_ in zip(rows, self.next[:, self.classes].tolist(), self.ended.tolist(), self.open.tolist()):
            row += [rows[n] for n in nexts]
            row += [ended, open_]
        return rows


def _advance(nfa: Nfa, fresh: frozenset, part: tuple, byte: int, kind: str) -> tuple[bool, tuple]:
    """The attempts of a rule after a byte: (a match ended before it, (pending, attempts by start))."""
    pending, attempts = part
    if pending:
        on = nfa.step(attempts[0], byte)
        if on:
            if nfa.end not in on:
                raise ValueError(f"rule {kind}: a match that can go on must stay a match")
            return False, (True, (on,))
        return True, _advance(nfa, fresh, (False, ()), byte, kind)[1]
    out, seen = [], frozenset()
    for attempt in (*attempts, fresh):
        on = nfa.step(attempt, byte) - seen
        if nfa.end in on:
            if out:
                raise ValueError(f"rule {kind}: a later attempt ends before an earlier one is decided")
            return False, (True, (on,))
        if on:
            out.append(on)
            seen |= on
    return False, (False, tuple(out))


def _minimised(nexts: np.ndarray, ended: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states that no text tells apart, by refinement; the start stays state 0."""
    block = np.unique(np.stack([ended, open_], axis=1), axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[nexts]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    keep = first[order]
    return name[block][nexts[keep]].astype(np.int32), ended[keep], open_[keep]


def _reversed(nfa: Nfa, classes: np.ndarray, members: list[int]) -> tuple[list[list[int]], list[bool]]:
    """Deterministic automaton of the reversed rule: next state for each byte (-1: none), and where a match may start."""
    moves, free = nfa.reversed()

    def closure(states) -> frozenset:
        seen, open_ = set(states), list(states)
        while open_:
            for state in free[open_.pop()]:
                if state not in seen:
                    seen.add(state)
                    open_.append(state)
        return frozenset(seen)

    first = closure([nfa.end])
    number, queue, rows, starts = {first: 0}, [first], [], []
    for states in queue:
        row = []
        for byte in members:
            target = closure({t for s in states for m, t in moves[s] if byte in m})
            if target and target not in number:
                number[target] = len(number)
                queue.append(target)
            row.append(number[target] if target else -1)
        rows.append([row[c] for c in classes])
        starts.append(nfa.start in states)
    return rows, starts


# --- scanning -----------------------------------------------------------------------------------------


class Scanner:
    def __init__(self, automaton: Automaton) -> None:
        self.rules, self.back = automaton.rules, automaton.back
        self.start = automaton.rows()[0]
        self.exact = [re.compile(r.pattern.encode(), re.I if r.any_case else 0) for r in self.rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        row, last, found = self.start, [0] * len(self.rules), []
        for i, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                self._close(row[256], i, data, last, found)
        if row[257]:
            self._close(row[257], len(data), data, last, found)
        return sorted(found)

    def _close(self, which: int, end: int, data: bytes, last: list[int], found: list) -> None:
        for r, rule in enumerate(self.rules):
            if not which >> r & 1:
                continue
            rows, starts = self.back[r]
            state, start = 0, end
            for at in range(end - 1, last[r] - 1, -1):
                state = rows[state][data[at]]
                if state < 0:
                    break
                if starts[state]:
                    start = at
            last[r] = end
            match = self.exact[r].fullmatch(data, start, end)
            if match and len(match[rule.group]) >= rule.least:
                found.append((start, r, end))


def _characters(data: np.ndarray, spans: list) -> list[tuple[int, int, int]]:
    """Byte positions as positions of code points."""
    if not spans:
        return []
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(before[a]), r, int(before[b])) for a, r, b in spans]


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(automaton)
        kinds = [r.kind for r in automaton.rules]
        base = {r.kind for r in BASE}
        for batch in batches:
            buf, at = column_bytes(batch.column("text"))
            counts, digests, texts = {k: [] for k in base}, [], []
            for i in range(batch.num_rows):
                text = buf[at[i] : at[i + 1]]
                spans = [(kinds[r], f"{kinds[r]}:{a}:{b}") for a, r, b in _characters(text, scanner.spans(text.tobytes()))]
                for kind in base:
                    counts[kind].append(sum(k == kind for k, _ in spans))
                digests.append(hashlib.sha256(",".join(s for k, s in spans if k in base).encode()).hexdigest())
                texts.append(",".join(s for _, s in spans))
            columns = [*(pa.array(counts[k.kind], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.split()[0] for f in FOUND.split(", ")])

    return run


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of `docs` (doc_id, text): counts of the base kinds, digest of their spans, and all spans.

    Spans are `kind:start:end` in code points, end exclusive, by start and then kind in the order of the
    rules. A missing text is an empty one; it has no spans, an empty list, and the digest of an empty
    text. Letters of any case are those of ASCII. Repeated rows are scanned each; other columns are
    ignored; an empty table gives an empty result.
    """
    settings(docs.sparkSession)
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(Automaton(rules)), FOUND)
