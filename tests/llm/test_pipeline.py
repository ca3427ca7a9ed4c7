"""The stages one by one on the sample tables, and what the entry module offers."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from eventlake.llm.mixing import mix_report
from eventlake.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
    good, distinct, clean, mixed, tokens = seen
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] < ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    assert tokens.count() == mixed.count()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    coder = pytest.importorskip("tokenizers").Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    for row in tokens.collect():
        ids_ = [*coder.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 2]
        assert (row["n_tokens"], row["ids_crc32"]) == (len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes()))


def test_run_and_entry(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_from_080_on(spark):
    """Of 51 five-word shingles each, 46 are common: 0.82 is a copy; with two words changed, 0.69 is none."""
    words = [f"w{i}" for i in range(55)]
    near, far = [*words[:20], "other", *words[21:]], [*words[:20], "new", *words[21:40], "newer", *words[41:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SF).collect()} == {1, 3}


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def planted():
    """Documents with copies from exact to 0.8, quotes of an item, rows without an id, repeated ids, and empty texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    item = text(40)
    rows = []
    for base in range(25):
        own = text(rng.choice([60, 120, 400]))
        rows.append((base, " ".join(own)))
        for k in range(rng.randrange(4)):
            copy = list(own)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.choice([None, 100 + 10 * base + k, 100 + 10 * base + k]), " ".join(copy)))
    rows += [(500, " ".join(text(30) + item + text(30))), (501, " ".join(text(50) + item[:35] + text(50))), (502, " ".join(text(50) + item[:20] + text(50)))]
    rows += [(600, None), (601, ""), (602, " \n"), (0, " ".join(text(70))), (700, rows[0][1]), (700, rows[0][1])]
    rng.shuffle(rows)
    return rows, " ".join(item)


def table_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def exact(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


def test_near_duplicate_stage_row_by_row(spark):
    rows, _ = planted()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[top(i)] = top(j)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(top(i) if sets[i] else -1 - i, []).append((d is None, d if d is not None else 0, t))
    kept = corpus_pipeline.distinct(spark, table_of(spark, rows), SF)
    got = exact(kept)
    assert len(got) == len(groups) and [d for d, _ in got] == sorted(str(min(g)[1]) if not min(g)[0] else "None" for g in groups.values())
    assert set(got) <= {(str(d), str(t)) for d, t in rows}


def test_decontamination_stage_row_by_row(spark, tmp_path):
    """A quote of 0.8 of the item's shingles goes, half of them stays."""
    rows, item = planted()
    path = str(tmp_path)
    spark.createDataFrame([(1, item), (2, None), (3, "...")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    own = shingles(item)
    want = [(d, t) for d, t in rows if len(own & shingles(t)) < 0.8 * len(own)]
    assert {500, 501} == {d for d, _ in rows} - {d for d, _ in want}
    assert exact(corpus_pipeline.clean(spark, table_of(spark, rows), path)) == sorted((str(d), str(t)) for d, t in want)


def test_quality_and_mixing_stages_row_by_row(spark, tmp_path):
    rows, _ = planted()
    path = str(tmp_path)
    labels = [(d, int(d % 2 == 0)) for d, _ in rows if d is not None and d < 400]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    docs = table_of(spark, rows)
    scores = quality_scores(docs.withColumnRenamed("doc_id", "d").withColumn("doc_id", F.monotonically_increasing_id()), spark.createDataFrame([], "doc_id long, quality int"))
    assert scores.count() == len(rows)
    judged = quality_scores(docs, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1").select("doc_id").collect()
    kept = corpus_pipeline.good(spark, docs, path)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in judged)
    assert set(exact(kept)) <= {(str(d), str(t)) for d, t in rows}
    ided = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in ided.collect()}
    taken = {r["doc_id"]: r["taken"] for r in mix_report(ided).collect()}
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, ided, path).collect())
    assert all(mixed[d] * words[d] == taken[d] for d in words) and sum(taken.values()) > sum(words.values())
