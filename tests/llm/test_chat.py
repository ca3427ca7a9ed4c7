"""Snapshot collapse against a comparison of all pairs of conversations."""

import random

from eventlake.llm import chat
from eventlake.llm.chat import render_chats


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "unknown", text or ""))
    seqs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        order = lambda x: (x is None, x or 0)
        twin = any(o == s and order(d) < order(c) for d, o in seqs.items() if d != c)
        if not longer and not twin:
            out[c] = (len(s), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s))
    return out


def rows():
    rng, out = random.Random(3), []
    for c in range(80):
        n = rng.randrange(1, 7)
        line = [("user", "hello"), *[(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(n)]]
        for snapshot in range(rng.randrange(1, 4)):
            for turn, (role, text) in enumerate(line[: max(1, len(line) - snapshot)]):
                out.append((c * 10 + snapshot, turn * 2 + snapshot, role, text))
    out += [(2000, 0, None, None), (2001, 0, "unknown", ""), (2002, 0, "user", "hello\x00"), (None, 1, "user", "x"), (None, 2, "user", "y")]
    return out + [(3000, t, "user", f"turn {t}") for t in range(30)]


def check(spark):
    table = spark.createDataFrame([(*r, 9) for r in rows()], "conv_id long, turn long, role string, text string, position int").repartition(6)
    got = {}
    for r in sorted(render_chats(table).collect(), key=lambda r: r["part"]):
        got[r["conv_id"]] = (r["n_turns"], got.get(r["conv_id"], (0, ""))[1] + r["text"])
    assert got == brute(rows())


def test_equals_brute_force(spark):
    check(spark)


def test_long_conversations_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    monkeypatch.setattr(chat, "PART", 7)
    check(spark)


def test_empty_table(spark):
    assert render_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
