"""The discriminant: densities by formula, held-out accuracy, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from eventlake.llm import quality
from eventlake.llm.quality import FEATURES, RIDGE, SHRINK, Discriminant, keep_good, quality_scores, statistics

SF = "/root/testdata/sf0.01"


def test_scores_equal_the_density_formula():
    rng = np.random.default_rng(0)
    n = len(FEATURES)
    x = {0: rng.normal(size=(300, n)) @ rng.normal(size=(n, n)), 1: rng.normal(size=(900, n)) + 1}
    model = Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()})
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in x.values()) / 1200
    scale = np.sqrt(np.diag(pooled))
    density = {}
    points = rng.normal(size=(20, n))
    for k, v in x.items():
        own = ((1 - SHRINK) * np.cov(v.T, bias=True) + SHRINK * pooled) / np.outer(scale, scale) + RIDGE * np.eye(n)
        z = (points - v.mean(0)) / scale
        density[k] = np.log(len(v)) - np.linalg.slogdet(own)[1] / 2 - np.einsum("ij,jk,ik->i", z, np.linalg.inv(own), z) / 2
    assert np.allclose(model.scores(points), 1 / (1 + np.exp(density[0] - density[1])))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_scores(docs, labels).collect()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in tested]) > 0.97
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_statistics_of_odd_texts():
    x = statistics(pa.array(["", None, " \n ", "a", "A" * 100_000, "word " * 30_000, "é" * 50]))
    assert np.isfinite(x).all() and not x[:3].any()


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (None, None, 0.1), (1, "a b", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1
    assert quality_scores(docs.limit(0), labels).count() == 0 and quality_scores(docs, labels.limit(0)).count() == 3
    assert "lang" not in quality.FEATURES


def plain_statistics(text):
    """The features of a text by their wording, without the operator's code."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    n = len(words)
    if not n:
        return [0.0] * 10
    share = lambda kind: np.sqrt(len(re.findall(kind, raw)) / solid)
    solid = max(len(re.findall(rb"[\x21-\xff]", raw)), 1)
    counts = Counter(words)
    return [
        min(np.log1p(n), 7), np.log(solid / n), share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"[.,;:'\"()?-]"), share(rb"[!#$%&*+/<=>@\[\\\]^_`{|}~]"),
        np.log(len(counts)) / np.log(n) if n > 1 else 1.0, np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / (n + 10)),
        np.sqrt(max(counts.values()) / (n + 10)), np.sqrt(raw.count(b"\n") / (n + 10)),
    ]


def plain_scores(docs, labels):
    """Scores of (doc_id, text) rows: fold, join, class moments, shrinkage and densities written out."""
    x = np.array([plain_statistics(t) for _, t in docs])
    outside = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    taught = {0: [], 1: []}
    for i, (d, _) in enumerate(docs):
        for label, quality_ in labels:
            if d is not None and label == d and quality_ in (0, 1) and not outside(d):
                taught[quality_].append(x[i])
    n = {k: len(v) for k, v in taught.items()}
    cov = {k: np.cov(np.array(v).T, bias=True) for k, v in taught.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.clip(np.diag(pooled), 1e-8, None))
    density = {}
    for k, v in taught.items():
        own = ((1 - SHRINK) * cov[k] + SHRINK * pooled) / np.outer(scale, scale) + RIDGE * np.eye(10)
        z = (x - np.mean(v, axis=0)) / scale
        density[k] = np.log(n[k]) - np.linalg.slogdet(own)[1] / 2 - np.einsum("ij,jk,ik->i", z, np.linalg.inv(own), z) / 2
    return [(d, outside(d), s) for (d, _), s in zip(docs, 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))))]


def test_scores_from_texts_to_end(spark):
    """Statistics, fold, join with the labels, sums and scores against a second computation."""
    rng = random.Random(5)
    words = ["Alpha", "beta", "the", "of", "X9", "don't", "(see)", "é", "!!", "<b>", "a", "\x01", "日本"]
    text = lambda good: rng.choice([" ", "\n", " "]).join(rng.choice(words[: 6 if good else 13]) for _ in range(rng.choice([0, 1, 3, 20, 60])))
    docs = [(i, text(i % 3 > 0)) for i in range(200)] + [(7, "again"), (7, "again"), (None, "no id"), (300, None), (301, "\x01\x02 \x00"), (302, "\x01")]
    labels = [(i, int(i % 3 > 0)) for i in range(150)] + [(301, 0), (302, 1), (5, None), (6, 9), (None, 1)]
    got = quality_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int"))
    key = lambda r: (str(r[0]), r[2])
    rows, want = sorted((tuple(r)[:3] for r in got.collect()), key=key), sorted(plain_scores(docs, labels), key=key)
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    assert np.allclose([r[2] for r in rows], [w[2] for w in want], atol=1e-6)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.collect())
