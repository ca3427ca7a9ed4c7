"""SimHash near-duplicates by BK-trees (operator 13).

A text's fingerprint has 64 bits: bit i is set when over half of the XXH64 hashes of its three-word
shingles, repeats included, have it set. Fingerprints are linked when they differ in at most `RADIUS`
bits.

Equal fingerprints are one row throughout. Shards: with the bits in `RADIUS` + 1 blocks, two linked
fingerprints agree in one whole block, so the fingerprints that agree in a block form a shard, and a
fingerprint meets no tree but those of its own blocks. A shard above `SHARD` rows is cut again by the
same rule over its free bits; a shard with 14 free bits cannot be larger than that, so trees are
bounded and nothing is left out. In a shard's BK-tree a child hangs on its parent by an edge, their
Hamming distance. The tree is sent to every block of its shard's queries; a query at distance d from a node
goes on only over the edges d - `RADIUS` to d + `RADIUS`. A task returns stars of connected
fingerprints, at most one link for each, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import forget, maybe_broadcast, select_only, settings, stored
from eventlake.llm.components import components

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 2
# Fingerprints in a tree, queries it meets at a time, pairs of query and node looked at together.
SHARD, BLOCK, FRONT = 1 << 14, 1 << 12, 1 << 20
# Bytes of a text whose words are held at a time; rows of a broadcast table (two longs each).
PIECE, BROADCAST_IDS = 1 << 20, 1_000_000
EDGES = BITS + 1


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces; a piece begins with the last words of the one before, so that no shingle is lost."""
    carried: list[bytes] = []
    begin = 0
    while begin < len(text):
        end = min(begin + PIECE, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carried + text[begin:end].lower().split()
        yield words
        carried, begin = words[len(words) - min(WORDS - 1, len(words)) :], end


def fingerprint(text: bytes | None) -> int:
    """Majority of each bit over the hashes of the three-word shingles; of fewer words, of the one sequence; of none, 0."""
    ones, total, few = np.zeros(BITS, np.int64), 0, []
    for words in _word_pieces(text or b""):
        if len(words) < WORDS:
            few = words
            continue
        joined = b" ".join(words)
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(few), SEED) if few else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


class Forest:
    """BK-trees of several shards in arrays: node i has the value fps[i] and hangs on parent[i] by edge[i]."""

    def __init__(self, fps: np.ndarray, parent: np.ndarray, edge: np.ndarray) -> None:
        self.fps, self.parent, self.edge = fps, parent, edge
        keys = np.where(parent < 0, -1, parent * EDGES + edge)
        self.child = np.argsort(keys, kind="stable")
        self.keys = keys[self.child]

    @classmethod
    def build(cls, fps: np.ndarray, shard: np.ndarray) -> Forest:
        """Insert all values, those of each shard in their order, a level of all trees at a time.

        The first value to reach an edge becomes its node; those after it go on from that node.
        """
        parent, edge = np.full(len(fps), -1, np.int64), np.zeros(len(fps), np.int64)
        waiting, key = np.arange(len(fps)), shard.astype(np.int64)
        while len(waiting):
            _, first, slot = np.unique(key, return_index=True, return_inverse=True)
            node = waiting[first][slot]
            rest = node != waiting
            waiting, node = waiting[rest], node[rest]
            parent[waiting] = node
            edge[waiting] = np.bitwise_count(fps[waiting] ^ fps[node])
            key = node * EDGES + edge[waiting]
        return cls(fps, parent, edge)

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) of values that differ in at most `radius` bits."""
        waiting = [(np.arange(len(queries)), roots)]
        while waiting:
            asked, node = waiting.pop()
            if len(asked) > FRONT:
                half = len(asked) // 2
                waiting += [(asked[:half], node[:half]), (asked[half:], node[half:])]
                continue
            away = np.bitwise_count(queries[asked] ^ self.fps[node]).astype(np.int64)
            hit = away <= radius
            yield asked[hit], node[hit]
            low = np.searchsorted(self.keys, node * EDGES + np.maximum(away - radius, 1))
            high = np.searchsorted(self.keys, node * EDGES + np.minimum(away + radius, BITS), side="right")
            count = high - low
            if count.any():
                at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                waiting.append((np.repeat(asked, count), self.child[at]))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, least value) that connect the same values as the links (a, b), one for each value."""
    names, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        for side in (x, y):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == before).all():
            moved = label != np.arange(len(names))
            return names[moved], names[label[moved]]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree for each row (fps): the number of the parent within the row, and the edge to it."""
    for batch in batches:
        lists = batch.column("fps")
        lengths = lists.value_lengths().to_numpy()
        starts = np.cumsum(lengths) - lengths
        shard = np.repeat(np.arange(len(lengths)), lengths)
        forest = Forest.build(lists.flatten().to_numpy().view(np.uint64), shard)
        offsets = pa.array(np.append(starts, lengths.sum()), pa.int32())
        parent = np.where(forest.parent < 0, -1, forest.parent - starts[shard]).astype(np.int32)
        columns = [lists, *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (parent, forest.edge.astype(np.int8)))]
        yield pa.RecordBatch.from_arrays(columns, ["fps", "parent", "edge"])


def _search(radius: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("fps").value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            fps = batch.column("fps").flatten().to_numpy().view(np.uint64)
            parent = batch.column("parent").flatten().to_numpy().astype(np.int64)
            forest = Forest(fps, np.where(parent < 0, -1, parent + np.repeat(starts, lengths)), batch.column("edge").flatten().to_numpy().astype(np.int64))
            first = starts + size * batch.column("block").to_numpy()
            number = np.minimum(first + size, starts + lengths) - first
            asked = np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())
            for query, node in forest.within(fps[asked], np.repeat(starts, number), radius):
                other = asked[query] != node
                a, b = fps[asked[query[other]]].view(np.int64), fps[node[other]].view(np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], ["a", "b"])

    return run


def _split(free: list[int], parts: int) -> list[list[int]]:
    return [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]


def _signed(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all values `fp` of a stored table within `radius` bits of each other."""
    parts, links = radius + 1, None
    # The fixed bits of each way to choose blocks, level by level.
    chosen: list[list[int]] = [[]]
    members = prints.select("fp", F.lit(0).alias("path"))
    while True:
        free = [[b for b in range(BITS) if b not in set(fixed)] for fixed in chosen]
        chosen = [fixed + block for fixed, left in zip(chosen, free) for block in _split(left, parts)]
        masks = F.array(*[F.lit(_signed(fixed)).cast("long") for fixed in chosen])
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        members = members.select("fp", (F.col("path") * parts).alias("path"), part).select("fp", (F.col("path") + F.col("part")).alias("path"))
        members = members.withColumn("key", F.col("fp").bitwiseAND(F.element_at(masks, F.col("path") + 1)))
        sizes = members.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = stored(members.join(sizes, ["path", "key"]), "bk-members")
        last = max(BITS - len(fixed) for fixed in chosen) <= max(int(SHARD).bit_length() - 1, parts)
        shards = (members if last else members.where(F.col("n") <= SHARD)).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        trees = shards.select("fps").mapInArrow(_build, "fps array<long>, parent array<int>, edge array<tinyint>")
        blocks = F.explode(F.sequence(F.lit(0), F.floor((F.size("fps") - 1) / F.lit(BLOCK)).cast("int"))).alias("block")
        asked = trees.select("*", blocks).repartition("block", F.element_at("fps", 1))
        found = stored(asked.mapInArrow(_search(radius, BLOCK), "a long, b long"), "bk-links")
        links = found if links is None else links.union(found)
        large = members.where(F.col("n") > SHARD)
        if last or large.isEmpty():
            return links
        members = large.select("fp", "path")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach. A missing or
    blank text has the fingerprint 0 and is linked like any other. Rows that repeat an id stay rows of
    their own. A row without an id is linked too; component_id is null only if no row of its component
    has an id. Other columns are ignored; an empty table gives an empty result.
    """
    settings(docs.sparkSession)
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    printed = stored(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "bk-prints")
    prints = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "bk-distinct")
    links = _links(prints, radius)
    roots = components(links, "bk-stars").withColumnRenamed("id", "fp")
    # Only values of several rows or with links: every other row is its own component.
    shared = prints.join(roots, "fp", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "fp"))
    shared = stored(shared.select("fp", "doc_id", "root"), "bk-shared")
    lowest = shared.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = stored(shared.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "bk-classes")
    forget(shared)
    return printed.join(maybe_broadcast(classes, BROADCAST_IDS), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
