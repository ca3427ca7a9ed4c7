"""Tree search against all inner products."""

import math

import numpy as np
import pytest

from eventlake.llm.topk import Space, Tree, routing_objects, top_k


def brute(rows, k=20):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, v string")
    return sorted(tuple(r) for r in top_k(table).select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.2]) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1300)]  # a vector that a third of the rows hold
    rows += [(1300, None), (1301, []), (1302, [1.0, None]), (1303, [float("nan")]), (1304, [float("inf")]), (None, [1.0]), (1320, [0.5, -0.5])]
    assert run(spark, rows) == brute(rows)


def test_large_components_take_part(spark):
    rows = [(20, [1.0, 1.0]), (1, [2.0**21, 0.0]), (2, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows) == [(20, 1, 1, 64 * 64 * 2**21), (20, 2, 2, 64 * 64)]
    rng = np.random.default_rng(4)
    for scale in (1e5, 2.0**23):  # products beyond what a double holds exactly, within 64 bits
        centres = rng.normal(size=(4, 3)) * scale / 8
        rows = [(i, [float(x) for x in np.clip(centres[i % 4] + rng.normal(size=3) * rng.choice([1, scale / 50]), -scale, scale)]) for i in range(500)]
        rows += [(i, [scale, -scale, 1.0]) for i in range(500, 530)] + [(540, [3e38, 1.0, float("inf")])]
        assert run(spark, rows) == brute(rows)


def test_few_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [-1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(0, [])]) == []


def test_tree_skips_what_the_bounds_rule_out():
    rng = np.random.default_rng(2)
    v = (64 * (rng.normal(size=(20, 1, 4)) * 4 + rng.normal(size=(20, 100, 4)) * 0.05)).astype(np.int64).reshape(-1, 4)
    space = Space(4, int((v * v).sum(1).max()))
    routing = routing_objects(space, v[::10], 40)
    far = space.between(v, routing)
    page = np.stack([far.argmin(1), np.zeros(len(v), int)], axis=1)
    ids = np.arange(len(v))
    tree = Tree(space, routing, ids, v, page, far.min(1))
    for i in range(0, len(v), 20):
        away = space.from_queries(float((v[i] * v[i]).sum()), space.products(v[i : i + 1], tree.tops)[0])
        scores, names = tree.search(i, v[i], 20, -np.inf, away)
        want = sorted((-s, j) for j, s in enumerate((v @ v[i]).tolist()) if j != i)[:20]
        assert sorted((-s, j) for s, j in zip(scores.tolist(), names.tolist())) == want
    assert tree.computed < 0.6 * len(v) * (len(v) / 20)


@pytest.mark.parametrize("large", [False, True])
def test_exact_for_large_components(large):
    v = np.array([[1 << 26, 3], [-(1 << 26), 5], [7, 1]], np.int64) if large else np.eye(3, dtype=np.int64)
    space = Space(v.shape[1], int((v * v).sum(1).max()))
    assert (space.products(v, v) == v @ v.T).all()
