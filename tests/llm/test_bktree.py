"""SimHash components by BK-trees against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from eventlake.llm import bktree
from eventlake.llm.bktree import Forest, fingerprint, simhash_components, stars


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, radius=2):
    """(smallest reachable id) for a list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(prints))]


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "日本", "Ab"]
    rows = [None, "", " \t\r\n", "One two", "one  TWO", "x", "one two three"]
    for _ in range(15):
        text = [rng.choice(words) for _ in range(rng.choice([2, 3, 5, 40, 400]))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n", " \x0b "]).join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("shard, block, piece", [(1 << 14, 1 << 12, 1 << 20), (3, 2, 64)])
def test_equals_all_pairs(spark, monkeypatch, shard, block, piece):
    monkeypatch.setattr(bktree, "SHARD", shard)
    monkeypatch.setattr(bktree, "BLOCK", block)
    rows = make(shard)
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fp string, component_id int").repartition(3)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash_components(docs).collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    assert got == {d: (p, c) for (d, p), c in zip(prints, brute(prints))}
    assert len({c for _, c in got.values()}) < len(rows) - 20


def test_pieces_of_long_texts(monkeypatch):
    text = " ".join(random.Random(2).choice("abcdef") * 7 for _ in range(5000))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(bktree, "PIECE", 50)
    assert fingerprint(text.encode()) == whole == plain_fingerprint(text)
    assert fingerprint(b"  a  \n b  ") == plain_fingerprint("a b")


@pytest.mark.parametrize("radius", [1, 2])
def test_large_shards_are_split_without_loss(spark, monkeypatch, radius):
    """Values close to few centres: blocks shared by hundreds, cut down to trees of at most eight."""
    monkeypatch.setattr(bktree, "SHARD", 8)
    rng = random.Random(radius)
    values = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(80):
            value = centre
            for _ in range(rng.randrange(7)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values = sorted(values)
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in bktree._links(prints, radius).collect()]
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[top(a)] = top(b)
    want = brute([(v, v) for v in values], radius)
    groups = {}
    for v in values:
        groups.setdefault(top(v), []).append(v)
    assert {v: min(g) for g in groups.values() for v in g} == dict(zip(values, want))


def test_tree_follows_edges_within_the_radius():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 3, np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, np.uint64)) for c in centre]))
    rng.shuffle(fps)
    forest = Forest.build(fps, np.zeros(len(fps), np.int64))
    inner = forest.parent >= 0
    assert (np.bitwise_count(fps[inner] ^ fps[forest.parent[inner]]) == forest.edge[inner]).all() and (~inner).sum() == 1
    assert len(set(zip(forest.parent[inner].tolist(), forest.edge[inner].tolist()))) == inner.sum()  # a child for each distance
    found = {(int(q), int(n)) for qs, ns in forest.within(fps, np.zeros(len(fps), np.int64), 2) for q, n in zip(qs, ns)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_stars_keep_the_components():
    a, b = np.array([5, 9, 1, 20, 7]), np.array([9, 7, 2, 21, 3])
    assert dict(zip(*(x.tolist() for x in stars(a, b)))) == {5: 3, 9: 3, 7: 3, 2: 1, 21: 20}


def test_missing_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "A b  c"), (None, "x y"), (7, None), (4, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash_components(docs).collect())
    assert got == [("4", "4"), ("5", "5"), ("5", "5"), ("7", "4"), ("None", "5"), ("None", "None")]
    assert simhash_components(docs.limit(0)).count() == 0
