"""Ranked search against scores computed one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventlake.llm import lexical
from eventlake.llm.lexical import Shard, search


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total = sum(n for _, _, n in held)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        asked = {t for i, text in items if i == item for t in terms(text)}
        weights = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in asked}
        scored = []
        for d, c, n in held:
            m = 50 + 50 * n * len(held) // total
            score = sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0))
        out += [(item, rank, None if gone else d, -score) for rank, (score, gone, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Été", "日本", "x" * 200, "Z9"]
    common = ["the", "of", "and"]
    joins = [" ", "-", "\n", "_", "\x00", "'", " . "]
    text = lambda n: rng.choice(joins).join(rng.choice(common if rng.random() < 0.4 else words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 2, 5, 30, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(7, docs[3][1]), (None, docs[3][1]), (None, docs[3][1]), (2000, None), (2001, " .\x7f"), (2002, "")]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 3, 8, 40]))) for i in range(25)]
    items += [(50, docs[0][1]), (51, None), (52, "..."), (3, "the W7"), (53, "nowhere"), (None, "the of"), (54, "The THE the"), (55, "x" * 200 + " " + "x" * 199)]
    return docs, items


@pytest.mark.parametrize("size, step, piece, k", [(1 << 14, 256, 1 << 20, 50), (40, 1, 16, 7)])
def test_equals_scores_one_by_one(spark, monkeypatch, size, step, piece, k):
    monkeypatch.setattr(lexical, "DOCS", size)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "PIECE", piece)
    monkeypatch.setattr(lexical, "SLICE", 500_000 if k == 50 else 60)
    docs, items = make(k)
    table = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, term string, n int").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in search(table, asked, k).collect()), key=lambda r: r[:2])
    assert got == brute(docs, items, k)


def test_reading_stops_early():
    """A document far ahead in one list settles the search; the tail of the list stays unread."""
    rows = pa.table({
        "doc_id": pa.array(range(5000), pa.int64()), "n": pa.array([1] * 10 + [200] * 4990, pa.int64()),
        "terms": pa.array([[0]] * 5000, pa.list_(pa.int32())), "counts": pa.array([[1]] * 5000, pa.list_(pa.int32())),
    })
    shard = Shard(rows, np.array([1000]), 5000, 5000)
    read = []
    real = shard.impact

    class Watched(np.ndarray):
        def __getitem__(self, item):
            if isinstance(item, slice):
                read.append(item.stop)
            return super().__getitem__(item)

    shard.impact = real.view(Watched)
    rows, scores = shard.search(np.array([0]), 5, 1)
    assert sorted(rows.tolist()) == list(range(10)) and len(set(scores.tolist())) == 1 and max(read) < 1000


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")], 50)
