"""Mixing: water levels against a plain loop, words taken against targets, reruns, odd rows."""

from fractions import Fraction

from pyspark.sql import functions as F

from eventlake.llm.mixing import mix, mix_report


def levels(sizes, weights, share=Fraction(3, 2), cap=2):
    target, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def docs(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot" if i % 3 else f"s{i % 7}", 1) for i in range(1500)]
    rows += [(2000, None, "hot", 1), (2001, "", None, 1), (2002, " a\tb\x0bc d ", None, 1), (None, "no id", "s1", 1), (7, rows[7][1], rows[7][2], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(7)


def test_targets_and_taken(spark):
    rows = mix_report(docs(spark)).join(docs(spark).select("doc_id", "source").distinct(), "doc_id").collect()
    sizes, weights, targets = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = r["source_size"]
        targets[r["source"]] = r["target"]
    for k, s in enumerate(sorted((s for s in sizes if s is not None)) + [None]):
        weights[s] = (5, 2, 1)[k % 3]
    want = levels(sizes, weights)
    for s in sizes:
        assert abs(targets[s] - float(want[s])) < 1e-6
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert abs(taken - targets[s]) <= 60 + 2, s  # half a document, and the row without an id
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[2002] == 3


def test_reruns_agree_and_mix_repeats_rows(spark):
    report = {r["doc_id"]: (r["size"], r["taken"]) for r in mix_report(docs(spark)).collect()}
    assert report == {r["doc_id"]: (r["size"], r["taken"]) for r in mix_report(docs(spark).repartition(3)).collect()}
    mixed = mix(docs(spark))
    assert mixed.columns == docs(spark).columns
    copies = {r["doc_id"]: r["n"] for r in mixed.where("doc_id != 7").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for i, (size, taken) in report.items():
        if size and i not in (7, None):
            assert copies.get(i, 0) * size == taken


def test_many_sources_and_empty_table(spark, monkeypatch):
    from eventlake.llm import mixing

    want = sorted(map(str, mix_report(docs(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mix_report(docs(spark)).collect())) == want
    assert mix_report(docs(spark).limit(0)).count() == 0
    assert mix_report(docs(spark).where("text = ''")).count() == 1
