"""The combined automaton against one regular expression after the other."""

import hashlib
import random
import re

import pytest

from eventlake.llm.secretscan import BASE, RULES, Automaton, Rule, Scanner, secrets

PLAIN = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


CASES = [
    "", "x", "token=abcdef", "token=token =abcdef", "TOKEN : 'abc123'", "api_key==abcdef apikey=\"abc", "token=secret=abcdef;",
    "AKIAKIA" + "A" * 14, "AKIA" + "1" * 15, "AKIA" + "1" * 16, "é" * 5 + "passwd:abcdef " + "0f" * 12, "0" * 23, "0" * 24 + "g" + "a" * 30,
    "tokentoken=abcdef", "passpassword=abcdef", "password password:  \"Zm9v+/=.-_", "secret\n=abcdef", "token=a" * 40, "ſecret=abcdef",
    "xtoken=" + "a" * 40 + " token=" + "0" * 40, "apiapi_key:AKIA" + "B2" * 10, "token\"  =  \"abcdef\"",
]


@pytest.fixture(scope="module")
def automaton():
    return Automaton(RULES)


def spans(scanner, text):
    data, kinds = text.encode(), {r.kind for r in BASE}
    found = [(len(data[:a].decode()), scanner.rules[r].kind, len(data[:b].decode())) for a, r, b in scanner.spans(data)]
    return [f"{k}:{a}:{b}" for a, k, b in found if k in kinds]


def test_cases(automaton):
    scanner = Scanner(automaton)
    for text in CASES:
        assert spans(scanner, text) == brute(text), text


def test_random_texts(automaton):
    scanner, rng = Scanner(automaton), random.Random(5)
    parts = ["token", "secret", "api_key", "api", "_", "key", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4", "0123456789abcdef", "deadbeef", "x", "é", ".", "eyJ", "passwd", "pass", "PASSWORD", "\n", "zz"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert spans(scanner, text) == brute(text), text


def test_added_kinds(automaton):
    scanner = Scanner(automaton)
    text = "ghp_" + "a1B2" * 9 + " eyJab.eyJcd.ef -----BEGIN RSA PRIVATE KEY-----"
    assert [scanner.rules[r].kind for _, r, _ in scanner.spans(text.encode())] == ["github", "jwt", "pem"]


def test_minimised(automaton):
    assert len(automaton.next) < 3000 and automaton.next.max() < len(automaton.next)


def test_rules_that_cannot_be_scanned_in_one_pass_are_refused():
    with pytest.raises(ValueError):
        Automaton((Rule("empty", "a*"),))
    with pytest.raises(ValueError):
        Automaton((Rule("goes on", "a(bc)*"),))


def test_table(spark):
    rows = [(i, t, "extra") for i, t in enumerate([*CASES, None, "a b " * 50_000 + "token=abcdef"])] + [(None, CASES[2], "extra"), (2, CASES[2], "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r["doc_id"], r["spans"], r["base_sha256"]) for r in secrets(docs).collect()}
    assert secrets(docs).count() == len(rows) and secrets(docs.limit(0)).count() == 0
    for i, text, _ in rows:
        joined = ",".join(brute(text or ""))
        assert (i, joined, hashlib.sha256(joined.encode()).hexdigest()) in got
