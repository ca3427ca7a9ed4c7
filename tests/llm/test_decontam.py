"""Retrieval and verification against a comparison of every document with every item."""

import random
import re

import numpy as np
import pyarrow as pa

from eventlake.llm.decontam import Index, leaks, term_column, without_leaks


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(words):
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs, items, overlap=0.8):
    out = set()
    longest = max((len(terms(t)) for _, t in items), default=0)
    for d, text in docs:
        words = terms(text)
        for i, item in items:
            own = terms(item)
            for a in range(0, max(len(words) - longest, 1), longest or 1):
                passage = words[a : a + 2 * longest]
                if len(own) < 5:
                    hit = own and any(passage[k : k + len(own)] == own for k in range(len(passage)))
                else:
                    hit = own and len(runs(own) & runs(passage)) / len(runs(own)) >= overlap - 1e-12
                if hit:
                    out.add((d, i))
    return out


def make(seed):
    rng = random.Random(seed)
    common, rare = "the of to and in it is".split(), [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    items = [(i, text(rng.choice([4, 6, 12, 30, 45])) + ". " + text(3)) for i in range(60)] + [(60, None), (61, ""), (62, "the of"), (63, "... !")]
    docs = []
    for d in range(150):
        words = text(rng.randrange(5, 300)).split()
        quote = rng.choice(items)[1]
        if quote and d % 3:
            quoted = quote.upper().split() if d % 2 else quote.split()
            for _ in range(d % 4):
                quoted[rng.randrange(len(quoted))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = quoted
        docs.append((d, " ".join(words)))
    return docs + [(150, None), (151, ""), (152, items[3][1]), (153, "the, 'of'"), (None, items[3][1]), (5, docs[5][1])], items


def test_equals_brute_force(spark):
    docs, items = make(1)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = leaks(table, bench).collect()
    want = brute(docs, items)
    assert len(want) > 60 and {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(r["overlap"] >= 0.8 for r in found)
    kept = without_leaks(table, bench)
    assert kept.columns == table.columns
    dirty = {d for d, _ in want}
    assert sorted(map(repr, ((r[0], r[1]) for r in kept.collect()))) == sorted(repr(d) for d in docs if d[0] not in dirty)


def test_wand_finds_what_full_scores_find():
    docs, items = make(2)
    index = Index(items)
    for _, text in docs:
        hashes, _ = term_column(pa.array([text or ""]))
        known = np.flatnonzero(np.isin(index.terms, hashes))
        scores = np.zeros(len(index.ids))
        for t in known:
            scores[index.items_of[t]] += index.impacts[t]
        assert sorted(index.retrieve(known)) == np.flatnonzero(scores >= 1 - 1e-9).tolist()


def test_empty_tables(spark):
    docs, items = make(3)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks(table, bench.limit(0)).count() == 0 and leaks(table.limit(0), bench).count() == 0
    assert without_leaks(table, bench.limit(0)).count() == len(docs)
