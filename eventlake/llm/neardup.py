"""Near-duplicate documents by SetSketch registers (operator 10).

A document is the set of its distinct five-word shingles. Each of its `M` registers keeps the smallest
of one exponential variate per shingle, on a scale with steps of factor `B` and truncated to 16 bits;
registers of a union are the larger of the two. Bands of `ROWS` registers are the buckets: at a
similarity of 0.85 a pair misses all of them about once in 10^8. Candidates must pass the joint
likelihood estimate (six standard errors below the threshold are let through) and are then verified on
their full sets.

Equal sets are one row throughout. No group is expanded into pairs: a bucket is first compared with its
hub only; what the verified links leave unconnected is compared with the rest of its hub's group, in
blocks inside tasks, on full sets, and only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import forget, maybe_broadcast, restored, select_only, settings, sheltered, stored
from eventlake.llm.components import components
from eventlake.llm.words import BASE, column_words, mix

WORDS, PERCENT = 5, 85
BANDS, ROWS = 32, 5
M, B, RATE, TOP = BANDS * ROWS, 1.001, 20.0, (1 << 16) - 1
# Shingles in a block of a group; partners of a hub that share a copy of its set.
BLOCK, PER_HUB, BROADCAST_IDS = 1_000_000, 500, 1_000_000

_rng = np.random.default_rng(10)
ODD = _rng.integers(0, 1 << 32, M, np.uint32) | np.uint32(1)
FACTORS = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than five words, one for all of them."""
    words, at = column_words(column)
    with np.errstate(over="ignore"):
        n = max(len(words) - WORDS + 1, 0)
        runs = np.zeros(n, np.uint64)
        for i, factor in enumerate(FACTORS):
            runs += words[i : i + n] * factor
        runs = mix(runs)
        for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
            if end - first >= WORDS:
                yield np.unique(runs[first : end - WORDS + 1])
            elif end > first:
                few = words[first:end]
                yield mix(np.sum(few * FACTORS[: len(few)], keepdims=True) + np.uint64(len(few)) * np.uint64(BASE))
            else:
                yield words[:0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a set of shingle hashes."""
    low = np.full(M, np.iinfo(np.uint32).max, np.uint32)
    half = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), 512):
        np.minimum(low, (half[k : k + 512, None] * ODD).min(axis=0), out=low)
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(B)), 0, TOP).astype("<u2")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sizes, names, regs = [], [], []
            for shingles in shingle_sets(batch.column("text")):
                sizes.append(len(shingles))
                names.append(mix(shingles * np.uint64(BASE)).sum(dtype=np.uint64))
                regs.append(registers(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(regs, pa.binary())],
                ["doc_id", "key", "n", "s", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            names = [mix(s * np.uint64(BASE)).sum(dtype=np.uint64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                ["s", "shingles"],
            )


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)


def estimate(more: np.ndarray, less: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Most likely similarities of sets of sizes `n` and `other`, from how many registers are larger or smaller."""
    u = (n / (n + other))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    up, down = _p(u - v * j), _p(v - u * j)
    same = np.clip(1 - up - down, 1e-12, None)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (M - more - less)[:, None] * np.log(same)
    best = like.argmax(axis=1)
    return j[np.arange(len(best)), best]


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows may reach the threshold: six standard errors are allowed for."""
    t = percent / 100
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return estimate(more, less, n, other) >= t - 6 * np.sqrt(t * (1 - t) / M)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, M)


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, other = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                good = likely(_regs(batch.column("ra")), _regs(batch.column("rb")), n, other, percent)
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(good))

    return run


class _Roots:
    """Components within a task, as far as its own links join them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, c: int) -> int:
        while c in self.up:
            c = self.up[c]
        return c


def _left_over(percent: int):
    """Links of a block of a hub's group, between rows of different components; at most one per component.

    Each set becomes numbers of the block's distinct shingles. A row outside the main component marks its
    own, and the marks are counted for all other rows at once: these are exact intersections.
    """

    def links(rows: pa.Table) -> tuple[list[int], list[int]]:
        side, s, comp = (rows[c].to_numpy() for c in ("side", "s", "comp"))
        sets = rows["shingles"].combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        _, number = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(sets.value_lengths().to_numpy())
        n = np.diff(ends, prepend=0)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return [], []
        each = np.concatenate([number[ends[y] - n[y] : ends[y]] for y in right])
        starts = np.cumsum(n[right]) - n[right]
        mark = np.zeros(number.max() + 1, np.int32)
        roots, a, b = _Roots(), [], []
        for x in left:
            own = number[ends[x] - n[x] : ends[x]]
            mark[own] = 1
            common = np.add.reduceat(mark[each], starts)
            mark[own] = 0
            near = 100 * common >= percent * (n[x] + n[right] - common)
            for y in right[near & (comp[right] != comp[x])]:
                p, q = roots.of(int(comp[x])), roots.of(int(comp[y]))
                if p != q:
                    roots.up[p] = q
                    a.append(int(s[x]))
                    b.append(int(s[y]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def batch_of(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = links(pa.Table.from_batches(rows))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in ("hub", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for first, end in zip(cuts, cuts[1:]):
                if tuple(key[:, first]) != now and held:
                    yield batch_of(held)
                    held = []
                now = tuple(key[:, first])
                held.append(batch.slice(first, end - first))
        if held:
            yield batch_of(held)

    return run


PAIRS = "a long, b long, na long, nb long"


def _verified(pairs: DataFrame, rows: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose full sets reach the threshold. A hub's set is sent once per 500 partners."""
    sets = stored(_full_sets(pairs.select(F.explode(F.array("a", "b")).alias("s")), rows, named), "near-full")
    with_b = pairs.join(sets.select(F.col("s").alias("b"), F.col("shingles").alias("sb")), "b")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).cast("int").alias("parts"))
    hubs = sets.select(F.col("s").alias("a"), F.col("shingles").alias("sa")).join(parts, "a")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", "salt", "sa")
    salted = with_b.join(parts, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("parts")))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        salted.join(hubs, ["a", "salt"])
        .select("a", "b", (F.col("na") + F.col("nb")).alias("n"), common.alias("common"))
        .where(100 * F.col("common") >= percent * (F.col("n") - F.col("common")))
        .select("a", "b")
    )


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, s) of every row of `docs`, and (s, doc_id, root) of every set that is not empty."""
    settings(docs.sparkSession)
    keyed = select_only(_with_key(docs), doc_id="doc_id", text="text", key="__key").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = keyed.select("doc_id", "text")
    sketched = stored(keyed.mapInArrow(_sketch, "doc_id long, key long, n long, s long, regs binary"), "near-sketch")
    sets = stored(
        sketched.where("n > 0").groupBy("s").agg(F.first("n").alias("n"), F.first("regs").alias("regs"), F.min("doc_id").alias("doc_id")),
        "near-sets",
    )

    size = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    key = F.expr(f"xxhash64(band, substring(regs, band * {size} + 1, {size}))").alias("bucket")
    members = sets.select("s", "n", "regs", band).select(key, "s", "n")
    hubs = members.groupBy("bucket").agg(F.min(F.struct("s", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(members.join(hubs, "bucket"), "near-members")

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    first = members.where("s != hub.s").select(F.col("hub.s").alias("a"), F.col("s").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    first = first.where(fits).distinct()
    for side in ("a", "b"):
        first = first.join(sets.select(F.col("s").alias(side), F.col("regs").alias(f"r{side}")), side)
    first = stored(first.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(percent), PAIRS), "near-pairs")

    links = stored(_verified(first, rows, sets, percent), "near-links")
    roots = stored(components(links, "near-stars"), "near-roots")

    more = _second_links(members, rows, sets, roots, percent)
    if not more.isEmpty():
        roots = stored(components(links.union(more), "near-stars"), "near-roots")
    forget(members)
    named = sets.select("s", "doc_id").join(roots.withColumnRenamed("id", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    return sketched.select("doc_id", "key", "n", "s"), named


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union. A missing, empty or blank text has
    the empty set and is linked with nothing. Rows that repeat an id stay rows of their own. A row
    without an id can be linked, but names its component only if no other row can: then component_id is
    null and the row is kept. Other columns are ignored; an empty table gives an empty result.
    """
    sketched, named = _components(docs, percent)
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = stored(named.join(lowest, "root").select("s", "component_id"), "near-classes")
    found = sketched.select("doc_id", "n", "s").join(classes, "s", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns, and every row whose text has no word.

    The row with the lowest doc_id stays (one without an id only if no other can), of several the one with the
    lowest hash of id and text. Rows are told apart by that hash, so rows without an id are dropped like others,
    and a copy takes no other text of its id with it. Of rows that repeat id and text one stays. Other columns
    may have any name.
    """
    docs, names = sheltered(docs, "doc_id", "text")
    sketched, named = _components(docs, percent)
    rows = sketched.where("n > 0").groupBy("key", "s").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("k"))
    rows = stored(rows, "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")
    firsts = rows.groupBy("s").agg(F.min(place).alias("first")).join(named.select("s", "root"), "s")
    keep = stored(firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key")), "near-keep")
    keys = rows.select(F.col("key").alias("__key"), "k")
    dropped = stored(keys.join(maybe_broadcast(keep, BROADCAST_IDS), "__key", "left_anti").select("__key"), "near-dropped")
    again = stored(keys.where("k > 1").join(maybe_broadcast(keep, BROADCAST_IDS), "__key", "left_semi").select("__key"), "near-again")
    left = _with_key(docs).join(maybe_broadcast(dropped, BROADCAST_IDS), "__key", "left_anti")
    if again.isEmpty():
        return restored(left, names)
    again = maybe_broadcast(again, BROADCAST_IDS)
    once = left.join(again, "__key", "left_semi").dropDuplicates(["__key"])
    return restored(left.join(again, "__key", "left_anti").unionByName(once), names)


def _full_sets(some: DataFrame, rows: DataFrame, named: DataFrame) -> DataFrame:
    """Full shingle sets of those listed in `some` (s), from one text each."""
    wanted = stored(named.join(some.distinct(), "s").where("doc_id IS NOT NULL").select("doc_id").distinct(), "near-wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    unnamed = rows.where("doc_id IS NULL")
    return texts.union(unnamed).mapInArrow(_sets, "s long, shingles array<long>").dropDuplicates(["s"])


def _second_links(members: DataFrame, rows: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links that the hubs have not shown, within buckets that still hold several components.

    All buckets of a hub form one group, so a set is sent once for it and not for every bucket. Rows
    outside the group's main component are compared with all others of the group, in blocks of bounded
    size, on full sets inside the tasks: only links come out.
    """
    placed = members.where("size > 2").join(roots.withColumnRenamed("id", "s"), "s", "left")
    placed = placed.select("bucket", "s", "n", F.col("hub.s").alias("hub"), F.coalesce("root", "s").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    # The hub itself was compared with everybody.
    grouped = stored(placed.where("s != hub").join(mixed, "bucket", "left_semi").select("hub", "s", "n", "comp").distinct(), "near-open")
    counted = grouped.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    groups = counted.groupBy("hub").agg(F.max(F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"))
    groups = groups.where("comps > 1").select("hub", F.col("main.comp").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = stored(grouped.join(groups, "hub").withColumn("own", F.pmod(F.hash("s"), F.col("blocks"))), "near-open")
    full = stored(_full_sets(open_.select("s"), rows, sets), "near-full")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    left = open_.where("comp != main").select("*", other).select("hub", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "s", "comp")
    right = open_.select("*", other).select("hub", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "s", "comp")
    blocks = left.union(right).join(full, "s").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    links = stored(blocks.mapInArrow(_left_over(percent), "a long, b long"), "near-links")
    forget(full)
    return links


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i + 4] END AS shingle
      FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
SELECT r.doc_id, CAST(coalesce(min(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""
