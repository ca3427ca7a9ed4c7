"""Repair of conversation structure by a generalised LR parser with weighted edits (operator 12).

Rows of a conversation, by turn, are the tokens of a small grammar over the initials of roles: an optional
system turn, then pairs of user and assistant turns, or nothing. A row is kept (0), reroled to what the
parser can shift (2) or deleted (3); empty user or assistant turns may be inserted anywhere (2 each). A
kept or reroled row that is cut off adds 1; blank and repeated rows must be deleted.

The stacks of all open parses share their lower nodes. After each row, stacks whose tops have the same
continuations are merged into the least by (cost, audit); the audit is the string of edit initials. Of two
audits that end in an edit of the same row none begins with the other, so their order is settled where
their paths part, and a rank for each top stands for the whole string.

No conversation is ever held: the parser streams over the sorted roles and faults, without the texts, and
gives an audit, a byte or so for a row; a second pass over the sorted rows applies it. Both passes read a
conversation's rows one after the other, as any hash of its whole text must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
INSERTED = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
WHITE = "\t\n\x0b\x0c\r "

# LR automaton of  D -> B | s B,  B -> P | B P,  P -> u a;  nothing at all is accepted in state 0.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (5, "u"): 2, (2, "a"): 6}
REDUCE = {4: ("B", 1), 6: ("P", 2), 7: ("B", 2)}
GOTO = {(0, "P"): 4, (1, "P"): 4, (3, "P"): 7, (5, "P"): 7, (0, "B"): 3, (1, "B"): 5}
ACCEPT = {0, 3, 5}
# Tops 3 and 5 have the same continuations.
NOTHING, SYSTEM, OPEN, PAIRS = 0, 1, 2, 3
SAME = {0: NOTHING, 1: SYSTEM, 2: OPEN, 3: PAIRS, 5: PAIRS}

# Rows whose audit is held as one text; rows and characters of an output batch.
CHUNK, ROWS, CHARS = 512, 1000, 4 << 20

Stack = tuple  # (state, stack below or None)


def shift(stack: Stack, initial: str) -> Stack | None:
    """The stack after a token and all reductions, or None where the automaton can't shift it."""
    state = SHIFT.get((stack[0], initial))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        symbol, size = REDUCE[stack[0]]
        for _ in range(size):
            stack = stack[1]
        stack = (GOTO[stack[0], symbol], stack)
    return stack


def inserts(stack: Stack) -> Iterator[tuple[str, Stack]]:
    """The initials of up to two inserted turns, and the stack after them; a third would only come back to an earlier top."""
    waiting = [("", stack)]
    while waiting:
        names, at = waiting.pop(0)
        yield names, at
        if len(names) < 2:
            waiting += [(names + i, t) for i in INSERTED if (t := shift(at, i))]


class Move(NamedTuple):
    audit: str
    cost: int
    stack: Stack


class Moves(dict):
    """All ways to read a row with this initial from a stack; deleting after an insertion is never least."""

    def __missing__(self, key: tuple[Stack, str]) -> list[Move]:
        stack, initial = key
        moves = [Move("D", DELETE, stack)]
        for names, at in inserts(stack):
            cost = INSERT * len(names)
            if after := shift(at, initial):
                moves.append(Move("I" * len(names) + "K", cost, after))
            moves += [Move("I" * len(names) + "R", cost + REROLE, t) for i in INSERTED if (t := shift(at, i))]
        self[key] = moves
        return moves


MOVES = Moves()


class Top(NamedTuple):
    cost: int
    rank: int
    stack: Stack
    trail: tuple  # (trail before, audit of the last rows)


def step(tops: list[Top], role: str, fault: str | None) -> list[Top]:
    """Read a row with every stack; equal tops are merged by (cost, audit)."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else ""
    must_go = fault in (BLANK, DUPLICATE)
    cut = CUT if fault == TRUNCATED else 0
    least: dict[int, tuple] = {}
    for top in tops:
        for move in MOVES[top.stack, initial]:
            if must_go and move.audit != "D":
                continue
            key = (top.cost + move.cost + (0 if move.audit == "D" else cut), top.rank, move.audit)
            kind = SAME[move.stack[0]]
            if kind not in least or key < least[kind][0]:
                least[kind] = (key, top, move)
    order = sorted(least.values(), key=lambda x: x[0][1:])
    return [Top(key[0], rank, move.stack, (top.trail, move.audit)) for rank, (key, top, move) in enumerate(order)]


def parse(rows: Iterator[tuple[str, str | None]]) -> tuple[int, str]:
    """Cost and audit of the least edits of rows (role, fault). Held are the audits of the open stacks, a byte or two a row."""
    tops, known = [Top(0, 0, (0, None), (None, ""))], set()

    def written(node: tuple | None, until: set[int]) -> tuple[tuple | None, str]:
        pieces = []
        while node is not None and id(node) not in until:
            node, piece = node
            pieces.append(piece)
        return node, "".join(reversed(pieces))

    for n, (role, fault) in enumerate(rows, 1):
        tops = step(tops, role, fault)
        if n % CHUNK == 0:
            tops = [top._replace(trail=written(top.trail, known)) for top in tops]
            known = {id(top.trail) for top in tops}
    ends = [
        ((top.cost + INSERT * len(names), top.rank, "I" * len(names)), top.trail)
        for top in tops
        for names, stack in inserts(top.stack)
        if stack[0] in ACCEPT
    ]
    (cost, _, last), trail = min(ends, key=lambda end: end[0])
    return cost, written(trail, set())[1] + last


def apply(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(turn, role before, role, text, edit) of rows (turn, role, text); the automaton tells the roles of reroled and inserted turns."""
    stack: Stack = (0, None)
    for edit in audit:
        if edit == "I":
            turn, before, text = None, None, ""
        else:
            turn, before, text = next(rows)
        role = before
        if edit in "IR":
            role = next(name for initial, name in INSERTED.items() if shift(stack, initial))
        if edit != "D":
            stack = shift(stack, role[:1])
        yield turn, before, role, text, edit


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted batches; the rows of one must be read before the next is asked for."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *columns))))
    ahead = next(rows, None)
    while ahead is not None:
        now = ahead[0]

        def same() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == now:
                row, ahead = ahead, next(rows, None)
                yield row[1:]

        yield now, same()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or size >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (f.split() for f in ddl.split(", "))])


AUDITS = "conv_id long, text string, faults string"
EDITS = "conv_id long, position long, turn long, role_before string, role string, text string, edit string, fault string"
FAULTS = {None: "-", BLANK: "b", DUPLICATE: "d", TRUNCATED: "t"}
NAMES = {v: k for k, v in FAULTS.items()}


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, own in _conversations(batches, ["role", "fault"]):
            seen = bytearray()

            def watched() -> Iterator[tuple]:
                for role, fault in own:
                    seen.extend(FAULTS[fault].encode())
                    yield role, fault

            yield conv, parse(watched())[1], seen.decode()

    return _batches(rows(), _schema(AUDITS))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, own in _conversations(batches, ["faults", "turn", "role", "text"]):
            faults, _, _, audit = next(own)  # sorted before the rows
            at = 0
            for position, (turn, before, role, text, edit) in enumerate(apply(audit, (row[1:] for row in own))):
                yield conv, position, turn, before, role, text, edit, None if edit == "I" else NAMES[faults[at]]
                at += edit != "I"

    return _batches(rows(), _schema(EDITS))


def _plain(conversations: DataFrame) -> DataFrame:
    rows = select_only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits that make each conversation (conv_id, turn, role, text) legal, one row for each, in order.

    conv_id, position (from 0), turn, role_before, role, text, edit (K, R, D or I), fault. What is not
    deleted, by position, is the repaired conversation. Rows go by turn, a missing one first, ties by role
    and the SHA-256 of the text; a missing role or text counts as one blank, rows without a conv_id as one
    conversation. A role fits by its first letter; an empty one fits nothing. The first of equal rows
    stays, the others are duplicates. Other columns are ignored; an empty table gives an empty result.
    """
    settings(conversations.sparkSession)
    end = F.rtrim("text", F.lit(WHITE))
    rows = _plain(conversations).withColumn("h", F.unhex(F.sha2("text", 256)))
    # The parser needs no texts; they are shuffled once, with the audits.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "h").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("own") == BLANK, BLANK).when(seen, DUPLICATE).otherwise(F.col("own"))
    own = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h"]
    tokens = rows.select("conv_id", "turn", "role", "h", own.alias("own")).repartition("conv_id").withColumn("fault", fault)
    audits = tokens.sortWithinPartitions(*order, F.col("fault").eqNullSafe(DUPLICATE)).select("conv_id", "role", "fault").mapInArrow(_audits, AUDITS)
    both = audits.select("*", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("h")).unionByName(
        rows.withColumn("faults", F.lit(None).cast("string"))
    )
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("faults").isNull(), *order[1:])
    return both.select("conv_id", "faults", "turn", "role", "text").mapInArrow(_applied, EDITS)


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(rows: Iterator[tuple]) -> tuple:
    found = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
    turns, first, turn, illegal, last, cost = 0, None, None, 0, None, 0
    audit, text, some = bytearray(), hashlib.sha256(), False
    for now, before, role, line, edit, fault in rows:
        audit += edit.encode()
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        cost += CUT if fault == TRUNCATED and edit != "D" else 0
        if edit != "D":
            text.update(f"{chr(10) if some else ''}{role}:{line}".encode())
            some = True
        if edit == "I":
            continue
        if fault:
            found[fault] += 1
        illegal += last is not None and last + before[:1] not in ("su", "ua", "au")
        last = before[:1]
        if now is not None and now != turn:
            first, turn, turns = now if first is None else first, now, turns + 1
    gaps = turn - first + 1 - turns if turns else 0
    return gaps, found[BLANK], found[DUPLICATE], found[TRUNCATED], illegal, cost, audit.decode(), text.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [f.split()[0] for f in EDITS.split(", ")[2:]]
    return _batches(((conv, *_digest(rows)) for conv, rows in _conversations(batches, columns)), _schema(DIGESTS))


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation of what `repair` returns, as it lies there: faults before, cost, audit, and a hash of the repaired lines."""
    return edits.mapInArrow(_digests, DIGESTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of id and turn: rows dropped, emptied, cut off, repeated, or given to the user."""
    shown: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = _plain(conversations).withColumn("x", (F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20).cast("int"))
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("x") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("x <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Digests of the repair of the damaged conversations, for every conv_id; zeros where no row is left."""
    ids = _plain(conversations).select(F.col("conv_id").alias("id")).distinct()
    found = digests(repair(damaged(conversations)))
    names = [f.split()[0] for f in DIGESTS.split(", ")[1:]]
    none = dict.fromkeys(names, 0) | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    both = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("id").alias("conv_id"), *[F.coalesce(n, F.lit(none[n])).alias(n) for n in names])
