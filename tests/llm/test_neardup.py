"""Near-duplicates against all pairs of shingle sets; the sketch against true similarities."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventlake.llm import neardup
from eventlake.llm.components import components
from eventlake.llm.neardup import M, estimate, near_duplicates, registers, shingle_sets, without_near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 200, 600]))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(text)
            for _ in range(int(len(text) * rng.choice([0, 0, 0.005, 0.01, 0.02, 0.1]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    chain = [rng.choice(words) for _ in range(100)]  # each is near the next, the ends are far apart
    for _ in range(25):
        chain[rng.randrange(100)] = rng.choice(words)
        rows.append((len(rows), "\n".join(chain)))
    rng.shuffle(rows)
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "two one")]


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PER_HUB", 500 if block > 1000 else 3)
    rows = make(block)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(4)
    want = brute(rows)
    assert result(near_duplicates(docs)) == want
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if w[2]}


def test_repeated_rows_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "x y"), (7, "A b  c")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "5", False), ("None", "None", True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for common, own, other in [(900, 50, 50), (500, 250, 250), (90, 0, 10), (2000, 300, 100)] * 10:
        x = rng.integers(0, 1 << 63, common + own + other, np.uint64) * np.uint64(2)
        a, b = x[: common + own], np.concatenate([x[:common], x[common + own :]])
        ra, rb = registers(a), registers(b)
        assert (np.maximum(ra, rb) == registers(np.union1d(a, b))).all()
        j = estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
        errors.append(j - common / len(x))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.5 * np.sqrt(0.25 / M)


def test_shingles_of_short_texts():
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(["a b", "b a", "a b c d e", "A B C D E f", None]))]
    assert [len(s) for s in sets] == [1, 1, 1, 2, 0] and sets[0] != sets[1] and sets[2] < sets[3]


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (300, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect())
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90, 300: 200, 200: 200}


def test_one_row_of_each_component_stays(spark):
    """Rows without an id, ids with several texts, and repeated rows."""
    text = " ".join(f"w{i}" for i in range(60))
    near, lone = text.replace("w59", "x"), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, near), (4, near), (4, near), (4, lone), (9, lone + " v60"), (None, "free one"), (None, "free one"), (5, None), (5, None)]
    rows += [(2, "unique text of two"), (2, text), (1, text)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = without_near_duplicates(docs)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert kept.columns == docs.columns
    assert got == sorted([(1, text), (4, lone), (None, "free one"), (5, None), (5, None), (2, "unique text of two")], key=repr)
