"""Columns whose names the operators use themselves come through unchanged."""

import pytest
from pyspark.sql import functions as F

from eventlake.llm.decontam import without_leaks
from eventlake.llm.linededup import dedup_lines
from eventlake.llm.mixing import mix
from eventlake.llm.neardup import without_near_duplicates

NAMES = ["__key", "__size", "__copies", "__copy", "__turn", "__salt", "__lines", "__drop", "n_lines", "n_dropped", "key", "s", "n", "regs", "root", "size", "a b", "line", "item_id"]


@pytest.mark.parametrize("run", [mix, without_near_duplicates, dedup_lines, lambda d: without_leaks(d, d.sparkSession.createDataFrame([(1, "quoted words of an item here")], "item_id long, text string"))])
def test_clashing_columns(spark, run):
    rows = [(1, "one two three four five six\nline", "s0"), (2, "one two three four five six\nline", "s0"), (3, None, None), (4, "seven eight nine ten eleven", "s1"), (5, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in NAMES])
    out = run(docs)
    added = ["n_lines", "n_dropped"] if run is dedup_lines else []
    assert sorted(out.columns) == sorted(docs.columns)
    got = out.collect()
    assert got and all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in NAMES if n not in added)
    assert not added or all(isinstance(r["n_lines"], int) for r in got)
