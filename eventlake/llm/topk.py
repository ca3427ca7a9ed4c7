"""Exact top-k inner products by best-first search in M-trees (operator 1).

Components are floor(64 * x). With the largest squared norm L of all vectors, giving each vector one
more component sqrt(L - |x|^2), and a query 0, turns the largest inner product into the smallest
Euclidean distance: d(q, x)^2 = |q|^2 + L - 2 q.x, so distances are exact up to one square root.

The index: routing objects are chosen from a bounded sample by farthest-first traversal; every vector
goes to its nearest one and into one of its pages, which are bounded and spread by hash, so a vector
that holds a third of the rows fills many pages. Pages lie in shards. A task has one shard and one
block of the stated queries; it builds a tree of routing groups, pages and entries, with covering radii
and distances to the parent, and searches it for each query. A distance is computed only if the stored
bounds allow the object into the query's ball, which starts at the k-th best of the sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings, stored

K, EVERY, SCALE = 20, 20, 64
# Bounded sample to choose routing objects from, their number, and sizes of pages, shards and blocks.
SAMPLE, ROUTING, PAGE, SHARD, BLOCK = 2048, 256, 1024, 32_768, 4096
EXACT = 1 << 52  # squared norms up to here leave every product and distance exact in a double


def _vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds floor(64 * x)."""
    rows = select_only(embeddings, vec_id="vec_id", v="embedding").where("vec_id IS NOT NULL AND v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(odd, F.lit(True))).select(
        F.col("vec_id").cast("long"), F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("v")
    )


def _matrix(column, dims: int) -> np.ndarray:
    """Integer vectors as rows, short ones filled with zeros."""
    out = np.zeros((len(column), dims), np.int64)
    lengths = np.fromiter((len(x) for x in column), np.int64, len(column))
    flat = column.flatten().to_numpy() if isinstance(column, pa.Array) else np.array([i for x in column for i in x], np.int64)
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Space:
    """Distances in the lifted space. Small: the routing objects and a sample travel with it.

    Up to `EXACT` all is exact as a double, which is faster. Beyond, products are 64-bit integers, so scores
    stay exact as long as they fit; distances are rounded, and `slack` is more than they can be off.
    """

    def __init__(self, dims: int, largest: float) -> None:
        self.dims, self.largest = dims, largest
        self.exact = largest < EXACT
        self.slack = 0.0 if self.exact else 8 * float(np.sqrt(largest * max(dims, 4) * 2.0**-50))

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return a.astype(np.float64) @ b.astype(np.float64).T
        return a @ b.T

    def square(self, v: np.ndarray) -> np.ndarray:
        return (v.astype(np.float64) ** 2).sum(axis=1)

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - self.square(v), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of vectors: their lifted components count."""
        square = self.square(a)[:, None] + self.square(b)[None, :] - 2.0 * (a.astype(np.float64) @ b.astype(np.float64).T)
        return np.sqrt(np.maximum(square + (self.lift(a)[:, None] - self.lift(b)[None, :]) ** 2, 0))

    def from_queries(self, norms: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms + float(self.largest) - 2.0 * products, 0))


def routing_objects(space: Space, sample: np.ndarray, count: int = ROUTING) -> np.ndarray:
    """Farthest-first traversal of the sample: each next object is the one farthest from all before it."""
    chosen = [0]
    far = space.between(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, space.between(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _assign(space: Space, routing: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = space.between(_matrix(batch.column("v"), space.dims), routing)
                nearest = far.argmin(axis=1)
                columns = [pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(nearest)), nearest])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["vec_id", "v", "routing", "far"])

    return run


class Tree:
    """Routing groups over pages over entries, for the vectors of one shard."""

    def __init__(self, space: Space, routing: np.ndarray, ids: np.ndarray, v: np.ndarray, page: np.ndarray, far: np.ndarray) -> None:
        order = np.lexsort((far, page[:, 1], page[:, 0]))
        self.space, self.ids, self.v, self.far, page = space, ids[order], v[order], far[order], page[order]
        self.values = self.v.astype(np.float64) if space.exact else self.v
        cuts = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]).any(axis=1), [True]]))
        self.first, self.end = cuts[:-1], cuts[1:]
        self.objects = routing[page[self.first, 0]]
        self.radius = self.far[self.end - 1]
        # Routing groups over the pages, again by farthest-first traversal.
        self.tops = routing_objects(space, self.objects, max(1, int(np.sqrt(len(self.first)))))
        apart = space.between(self.objects, self.tops)
        group = apart.argmin(axis=1)
        self.members = [np.flatnonzero(group == g) for g in range(len(self.tops))]
        self.to_parent = apart[np.arange(len(group)), group]
        self.cover = np.array([(self.to_parent[m] + self.radius[m]).max() if len(m) else -np.inf for m in self.members])
        self.computed = 0

    def search(self, own: int, q: np.ndarray, k: int, floor_: float, to_tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) among those of at least `floor_`, without the query's own row."""
        norm = float(self.space.square(q[None, :])[0])
        number = float if self.space.exact else int
        point = q.astype(np.float64) if self.space.exact else q

        def ball(score: float) -> float:
            if score == -np.inf:
                return np.inf
            distance = float(np.sqrt(max(norm + self.space.largest - 2.0 * score, 0)))
            return distance + 1e-6 * (1 + distance) + self.space.slack

        best, names, r = np.zeros(0, self.values.dtype), np.zeros(0, np.int64), ball(floor_)
        # Nodes by the least distance that anything below them can have; groups have negative numbers.
        heap = [(max(d - c, 0.0), -1 - g, d) for g, (d, c) in enumerate(zip(to_tops.tolist(), self.cover.tolist())) if d - c <= r]
        heapq.heapify(heap)
        while heap:
            bound, node, away = heapq.heappop(heap)
            if bound > r:
                break
            if node < 0:
                node = -1 - node
                pages = self.members[node]
                pages = pages[np.abs(to_tops[node] - self.to_parent[pages]) - self.radius[pages] <= r]
                if len(pages):
                    distances = self.space.from_queries(norm, self.space.products(q[None, :], self.objects[pages])[0])
                    self.computed += len(pages)
                    for d, p in zip(distances.tolist(), pages.tolist()):
                        if d - self.radius[p] <= r:
                            heapq.heappush(heap, (max(d - self.radius[p], 0.0), p, d))
                continue
            first, end = self.first[node], self.end[node]
            near = self.far[first:end]
            low = first + int(np.searchsorted(near, away - r - 1e-6 * away))
            high = first + int(np.searchsorted(near, away + r + 1e-6 * away, side="right"))
            if low < high:
                self.computed += high - low
                scores = self.values[low:high] @ point
                good = (scores >= floor_) & (self.ids[low:high] != own)
                if good.any():
                    best = np.concatenate([best, scores[good]])
                    names = np.concatenate([names, self.ids[low:high][good]])
                    if len(best) > k:
                        top = np.lexsort((names, -best))[:k]
                        best, names = best[top], names[top]
                    if len(best) == k:
                        floor_ = max(floor_, number(best.min()))
                        r = ball(floor_)
        return best, names


HITS = "query_id long, vec_id long, score long"


def _search(space: Space, routing: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
    def task(rows: pa.Table) -> pa.RecordBatch:
        side = rows["side"].to_numpy()
        v = _matrix(rows["v"].combine_chunks(), space.dims)
        ids = rows["vec_id"].to_numpy()
        data, asked = side == 0, np.flatnonzero(side == 1)
        out: list[tuple] = []
        if data.any() and len(asked):
            page = np.stack([rows["routing"].to_numpy()[data], rows["page"].to_numpy()[data]], axis=1)
            tree = Tree(space, routing, ids[data], v[data], page, rows["far"].to_numpy()[data])
            norms = space.square(v[asked])
            number = float if space.exact else int
            to_tops = space.from_queries(norms[:, None], space.products(v[asked], tree.tops))
            known = space.products(v[asked], sample)
            for i, row in enumerate(asked):
                others = known[i][sample_ids != ids[row]]
                floor_ = number(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else -np.inf
                scores, names = tree.search(ids[row], v[row], k, floor_, to_tops[i])
                out.append((np.full(len(names), ids[row]), names, scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = np.stack([batch.column(c).to_numpy() for c in ("shard", "block")])
            if (key[:, -1] == [held["shard"][0].as_py(), held["block"][0].as_py()]).all():
                continue
            key = np.stack([held[c].to_numpy() for c in ("shard", "block")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for first, end in zip([0, *cuts[:-1]], cuts):
                yield task(held.slice(first, end - first))
            held = held.slice(cuts[-1])
        if held is not None:
            yield task(held)

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best rows for each query of `embeddings` (vec_id, embedding): query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with another
    vec_id. Ties go to the smaller vec_id. Rows take no part whose vec_id or vector is missing, or whose
    vector has a missing or non-finite component. Scores are exact as long as they fit 64 bits. Shorter vectors are filled with
    zeros. Rows that repeat an id are candidates each; such an id asks once, by its smallest vector.
    With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    spark = settings(embeddings.sparkSession)
    vectors = stored(_vectors(embeddings), "topk-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, largest, dims = vectors.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    space = Space(max(dims or 0, 1), largest or 0.0)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in picked], np.int64)
    sample = _matrix([r["v"] for r in picked], space.dims)
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    routing = routing_objects(space, sample)

    schema = "vec_id long, v array<long>, routing int, far double"
    placed = stored(vectors.mapInArrow(_assign(space, routing), schema), "topk-placed")
    pages = placed.groupBy("routing").agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("pages"))
    questions = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(-(-n // SHARD), spark.sparkContext.defaultParallelism)
    blocks = -(-questions.count() // BLOCK) or 1

    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    paged = placed.join(F.broadcast(pages), "routing").withColumn("page", F.pmod(F.xxhash64("vec_id"), F.col("pages")).cast("int"))
    data = paged.select(
        F.pmod(F.hash("routing", "page"), F.lit(shards)).alias("shard"), numbers(blocks).alias("block"), F.lit(0).alias("side"), "vec_id", "v", "routing", "page", "far"
    )
    asked = questions.select(
        numbers(shards).alias("shard"), F.pmod(F.hash("vec_id"), F.lit(blocks)).alias("block"), F.lit(1).alias("side"), "vec_id", "v",
        F.lit(0).alias("routing"), F.lit(0).alias("page"), F.lit(0.0).alias("far"),
    )
    tasks = data.union(asked).repartition("shard", "block").sortWithinPartitions("shard", "block")
    hits = tasks.mapInArrow(_search(space, routing, sample_ids, sample, k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
