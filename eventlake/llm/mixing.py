"""Mixing sources to target weights by capped water-filling (operator 4). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import BROADCAST_ROWS, ranked, restored, select_only, settings, sheltered, stored

# Weights of the sources in code-point order, repeating; share of all words to take; most repeats.
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, 7
SALTS = 16


def word_count(text: Column) -> Column:
    """Words are runs of anything but blank and 0x09 to 0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a text that is never null; a missing source sorts last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def _turn(doc_id: Column, text: Column) -> Column:
    """Seeded order in which documents of a source get their fractional repetition."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))))


def water_levels(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add `target` to a stored table (source_size, weight).

    Sources whose proportional part is above `epochs` times their size stop there; what they leave is
    shared by weight among the others, until none is above. Each round is one aggregate over the
    table of sources; the level only rises, so a source that stopped stays stopped.
    """
    cap = F.col("source_size") * F.lit(epochs)
    total = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not total["n"]:
        return sources.withColumn("target", F.lit(0.0))
    left, weight, stopped = share * total["n"], float(total["w"]), -1
    while True:
        part = F.lit(left) * F.col("weight") / F.lit(weight)
        over = sources.where(part > cap).agg(F.count(F.lit(1)).alias("k"), F.sum(cap).alias("n"), F.sum("weight").alias("w")).first()
        if over["k"] == stopped or over["w"] == total["w"]:
            return sources.withColumn("target", F.when(part > cap, cap.cast("double")).otherwise(part))
        if over["k"] == 0:
            return sources.withColumn("target", part)
        stopped = over["k"]
        left, weight = share * total["n"] - over["n"], float(total["w"] - over["w"])


def decisions(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: its size, target, whole repetitions, and the last turn (`cut`) that gets one more.

    The documents of a source are lined up by their seeded turn; those before the fractional need is
    met get one repetition more, so a source misses its target by half a document at most. The running
    sum is taken over 65,536 ranges of turns first, then inside the one range where it is met.
    """
    rows = stored(
        select_only(docs, doc_id="doc_id", text="text", source="source").select(
            _key(F.col("source")).alias("key"),
            word_count(F.col("text")).alias("size"),
            _turn(F.col("doc_id"), F.col("text")).alias("turn"),
        ),
        "mix-rows",
    )
    # Pre-aggregated by range of turns: a hot source is summed in many tasks.
    ranges = stored(rows.groupBy("key", F.substring("turn", 1, 4).alias("range")).agg(F.sum("size").alias("n")), "mix-ranges")
    sizes = ranges.groupBy("key").agg(F.sum("n").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    numbered = stored(ranked(sizes, ["key"], [], "rank", "mix-sources").withColumn("weight", weight), "mix-weights")
    levels = stored(
        water_levels(numbered, share, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("key", "source_size", "target", "whole", "need"),
        "mix-levels",
    )
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(levels, "key")
        .where("before <= need")
        .groupBy("key")
        .agg(F.max(F.struct("range", "before", "need")).alias("e"))
        .select("key", F.col("e.range").alias("range"), F.col("e.before").alias("before"), F.col("e.need").alias("need"))
    )
    inside = Window.partitionBy("key").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, -1)
    met = (
        rows.withColumn("range", F.substring("turn", 1, 4))
        .join(edge, ["key", "range"])
        .withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .where(2 * F.col("run") + F.col("size") <= 2 * F.col("need"))
        .groupBy("key")
        .agg(F.max("turn").alias("last"))
    )
    return stored(
        levels.join(edge.select("key", "range"), "key", "left")
        .join(met, "key", "left")
        .select(
            "key", "source_size", "target", "whole",
            F.when(F.col("need") > 0, F.coalesce("last", "range")).otherwise("").alias("cut"),
        ),
        "mix-cuts",
    )


def _with_copies(docs: DataFrame, **how) -> DataFrame:
    """All columns of `docs`, plus __size, __source_size, __target and __copies."""
    settings(docs.sparkSession)
    cuts = decisions(docs, **how)
    rows = docs.withColumns(
        {
            "__key": _key(F.col("source")),
            "__size": word_count(F.col("text")),
            "__turn": _turn(F.col("doc_id"), F.col("text")),
        }
    )
    table = cuts.select(*[F.col(c).alias(f"__{c}") for c in cuts.columns])
    if table.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(table), "__key")
    else:  # many sources, of which some may be hot
        salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64("__turn"), F.lit(SALTS)).cast("int")).join(salted, ["__key", "__salt"])
    extra = F.when(F.col("__turn") <= F.col("__cut"), 1).otherwise(0)
    return joined.withColumn("__copies", F.col("__whole") + extra)


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes of it.

    A missing text has size 0; a missing source is a source of its own and comes last. Rows that
    repeat id and text are taken alike. An empty table gives an empty result.
    """
    return _with_copies(docs, **how).select(
        F.col("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, with their columns, whatever their names: each row as often as the mix takes it.

    Missing texts have size 0 and are left out unless their source is taken whole; a missing source is one of
    its own. Rows that repeat id and text are taken alike. An empty table gives an empty result.
    """
    inner, names = sheltered(docs, "doc_id", "text", "source")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return restored(_with_copies(inner, **how).withColumn("__copy", copies), names)


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS turn
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
        row_number() OVER (ORDER BY 2.0 * source_size / weight, source IS NULL, source) AS k,
        coalesce(sum(2 * source_size) OVER p, 0) AS stopped, coalesce(sum(weight) OVER p, 0) AS gone
      FROM w WINDOW p AS (ORDER BY 2.0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS free FROM o WHERE (1.5 * total - stopped) * weight / (all_weight - gone) <= 2 * source_size),
l AS (SELECT 1.5 * total - stopped AS rest, all_weight - gone AS weights FROM o, f WHERE k = free),
t AS (SELECT source, source_size, CAST(CASE WHEN k < free THEN 2.0 * source_size ELSE CAST(rest AS DOUBLE) * weight / weights END AS DOUBLE) AS target FROM o, f, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN need > 0 AND 2 * run + size <= 2 * need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""
