"""Repairs against a search over all edits, and the damage against its wording."""

import hashlib
import heapq
import random
import re
import tracemalloc
import zlib
from itertools import count

import pytest

from eventlake.llm import rolerepair
from eventlake.llm.rolerepair import apply, parse, repair, repair_report

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def fits(initials):
    """Whether some ending makes the initials legal."""
    return any(LEGAL.match(initials + end) for end in ("", "a", "ua"))


def search(rows):
    """Least (cost, audit, output) by trying all edits in order of cost, then audit; states are the initials' last part."""
    queue, done, number = [(0, "", 0, "", next(c := count()), ())], set(), c
    while queue:
        cost, audit, i, initials, _, out = heapq.heappop(queue)
        state = (i, initials[-1:] if initials else "", )
        if i == len(rows) and LEGAL.match(initials):
            return cost, audit, list(out)
        if i < len(rows) and state in done:
            continue
        if i < len(rows):
            done.add(state)
        short = initials[:1] if initials[:1] == "s" else ""
        short = initials if len(initials) < 4 else short + ("ua" if initials[-1] == "a" else "uau")
        options = []
        if i < len(rows):
            role, text, fault = rows[i]
            cut = fault == "truncated"
            options.append((3, "D", 1, "", None))
            if fault not in ("blank", "duplicate"):
                options.append((0 + cut, "K", 1, role[:1] or "#", (role, text)))
                options += [(2 + cut, "R", 1, n[0], (n, text)) for n in ("user", "assistant")]
        if not audit.endswith("III"):
            options += [(2, "I", 0, n[0], (n, "")) for n in ("user", "assistant")]
        for price, edit, step, initial, line in options:
            if fits(short + initial):
                heapq.heappush(queue, (cost + price, audit + edit, i + step, short + initial, next(number), (*out, line) if line else out))
    raise AssertionError("deleting everything is always legal")


def faults(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def digest(rows):
    """Digest of rows (turn, role, text) after damage, in order."""
    lines = faults([(r, t) for _, r, t in rows])
    cost, audit, out = search(lines)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[:1] + b[:1] for (a, _, _), (b, _, _) in zip(lines, lines[1:])]
    kinds = [f for _, _, f in lines]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def brute(table):
    groups = {}
    for conv, turn, role, text in table:
        shown = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        x = zlib.crc32(shown.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = groups.setdefault(conv, [])
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        role = "user" if x == 4 else role
        rows += [(turn, role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return {c: digest(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))) for c, rows in groups.items()}


def make(seed):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "", " \n", "Why? ", "a. b\x0b", "…", "é.", None, "ok."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Ass", "uncle"]
    table = []
    for conv in [None, *range(60)]:
        names = roles if conv is None or conv % 3 else roles[:2]
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            for _ in range(rng.choice([1, 1, 1, 1, 2, 0])):
                table.append((conv, rng.choice([turn, turn, turn, None, turn * 3 - 4]), names[turn % 2] if rng.random() < 0.6 else rng.choice(names), rng.choice(texts)))
    rng.shuffle(table)
    return table


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows, seed", [(1000, 1), (3, 2)])
def test_equals_search_over_all_edits(spark, monkeypatch, rows, seed):
    monkeypatch.setattr(rolerepair, "ROWS", rows)
    table = make(seed)
    df = spark.createDataFrame([(*r, "f", 1) for r in table], SCHEMA + ", fault string, position int").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair_report(df).collect()}
    assert got == brute(table)


@pytest.mark.parametrize("seed", range(6))
def test_parse_equals_search(monkeypatch, seed):
    monkeypatch.setattr(rolerepair, "CHUNK", 1 + seed % 3)
    rng = random.Random(seed)
    for _ in range(300):
        rows = faults([(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(["x.", "y.", "z", "", "w!", "v."])) for _ in range(rng.randrange(12))])
        cost, audit, out = search(rows)
        assert parse((role, fault) for role, _, fault in rows) == (cost, audit)
        edits = list(apply(audit, ((i, role, text) for i, (role, text, _) in enumerate(rows))))
        assert [(e[2], e[3]) for e in edits if e[4] != "D"] == out


def test_long_conversations_need_a_few_bytes_a_row():
    """A hundred thousand turns of one role: where to mend it stays open to the end."""
    rng = random.Random(5)
    rows = [("user" if i < 50_000 or i % 2 else rng.choice(["assistant", "user", "system"]), rng.choice([None] * 6 + ["blank", "truncated"])) for i in range(100_000)]
    tracemalloc.start()
    cost, audit = parse(iter(rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(audit) - audit.count("I") == 100_000 and most < 10 * 100_000 and cost > 0


def test_repaired_rows(spark):
    table = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So."), (1, 3, "user", "cut"), (2, 5, "system", "Be brief."), (2, 6, "user", "Yes?")]
    rows = repair(spark.createDataFrame(table, SCHEMA)).orderBy("conv_id", "position").collect()
    assert ["".join(r["edit"] for r in rows if r["conv_id"] == c) for c in (1, 2)] == ["KDIKR", "KKI"]
    assert [(r["role_before"], r["role"], r["text"]) for r in rows if r["conv_id"] == 2] == [("system", "system", "Be brief."), ("user", "user", "Yes?"), (None, "assistant", "")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).count() == 0 and repair_report(empty).count() == 0
