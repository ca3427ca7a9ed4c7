"""The bigram model against counts by dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

from eventlake.llm.ngram import fit, lm_scores


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not all(n):
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *(min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.85)))]


def brute(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    uni, pair = Counter(), Counter()
    for i, text in rows:
        if not held[i]:
            seq = words(text)
            uni.update(seq)
            pair.update(zip(["<s>", *seq], seq))
    n, v = sum(uni.values()), len(uni)
    cont, context = Counter(w for _, w in pair), defaultdict(list)
    for (a, _), c in pair.items():
        context[a].append(c)
    d1, d0 = discounts(pair.values()), discounts(cont.values())
    spare = sum(d0[min(c, 3)] for c in cont.values())

    def p(a, w):
        low = (max(cont[w] - d0[min(cont[w], 3)], 0) + spare / (v + 1)) / len(pair) if pair else 1 / (v + 1)
        if a not in context:
            return low
        free = sum(d1[min(c, 3)] for c in context[a])
        c = pair[a, w]
        return (max(c - d1[min(c, 3)], 0) + free * low) / sum(context[a])

    out = []
    for i, text in rows:
        seq = words(text)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq)
        score = sum(math.log10(p(a, w)) for a, w in zip(["<s>", *seq], seq))
        out.append((i, held[i], len(seq), sum(uni[w] > 0 for w in seq), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, n long, score long")
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm_scores(docs).collect()), key=repr)


def test_scores_equal_brute_force(spark):
    text = "the cat sat on the mat . the dog sat on the cat \n a b a b a c The END é É"
    rows = [(i, " ".join(text.split()[i % 7 : 9 + i % 11]) + f" w{i % 13} w{i % 5}") for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n"), (None, "the cat"), (3, rows[3][1]), (64, "unseen words here " * 400)]
    assert run(spark, rows) == brute(rows)


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [(i, f"a b c a{i % 3} b{i % 4} a b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from eventlake.llm.words import column_words

    import numpy as np
    import pyarrow as pa

    from eventlake.llm.ngram import END

    model = fit(docs)
    vocabulary = "a b c a0 a1 a2 b0 b1 b2 b3".split()
    w = np.append(column_words(pa.array(vocabulary))[0], [END, np.uint64(12345)])
    for context in w[:3]:
        total = (10 ** model.log10(model.lookup(np.full(len(w), context), w))).sum()
        assert abs(total - 1) < 1e-9


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(2, "only held out")])[0][4] in (0, 4)
