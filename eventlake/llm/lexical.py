"""Ranked lexical search by NRA, reading impact-sorted lists in sequence (operator 11).

All documents are ranked for each stated item. A document's score is the sum of its impacts for the
item's different terms; an impact is a whole number that depends on the term's weight, its occurrences and
the document's length, so scores are exact.

A first pass over the texts keeps, per document, its length and its counts of the items' terms, and the
sums over all documents come from that table. The second pass cuts each partition of it into shards of
bounded size. A shard holds a list for each term, sorted by falling impact. For an item its lists are
read side by side, further by steps that double, and never at random. At any time a document has a
lower bound, the impacts read so far, and an upper bound, which adds the next unread impact of each list
that has not shown it. Reading goes on until every document whose upper bound reaches the k-th best
lower bound has both bounds equal: then members, ties and scores are final. The k-th best score of a
task's earlier shards is a floor for later ones. Only k rows for each item leave a task.

The items are handled in slices of bounded size, each a pass over the documents; a slice's terms are
sent to the workers.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm.common import forget, select_only, settings, stored

K = 50
# Fixed values of the score: saturation, length share in percent, scale of a weight and of a term's part.
SATURATION, LENGTH, WEIGHT, SCALE = 20, 50, 1000, 1_000_000_000
# Pairs of item and term in a slice; documents and postings of a shard; first step of reading.
SLICE, DOCS, POSTINGS, STEP = 500_000, 1 << 14, 1 << 20, 256
# Bytes of a text whose terms are held at a time; longer terms are known by a digest.
PIECE, LONG = 1 << 20, 64

_kept = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
TERM_BYTES = bytes(b for b in range(256)).lower().translate(bytes(b if b in _kept else 0x20 for b in range(256)))


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size: runs of letters, digits and bytes above 0x7F, A to Z lowered."""
    begin = 0
    while begin < len(text):
        end = min(begin + PIECE, len(text))
        while end < len(text) and TERM_BYTES[text[end]] != 0x20:
            end += 1
        yield text[begin:end].translate(TERM_BYTES).split()
        begin = end


def _name(term: bytes) -> bytes:
    return term if len(term) <= LONG else b" " + hashlib.sha256(term).digest()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id"), batch.column("text")):
            terms = sorted({_name(t) for piece in term_pieces(text.as_py() or b"") for t in piece})
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])


class Slice:
    """Some items: their ids, all their terms, and for each item the numbers of its terms."""

    def __init__(self, pairs: list[tuple[int, bytes]]) -> None:
        self.number = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
        self.long = any(t[:1] == b" " for t in self.number)
        items: dict[int, list[int]] = {}
        for item, term in pairs:
            items.setdefault(item, []).append(self.number[term])
        self.ids = list(items)
        self.terms = [np.array(t) for t in items.values()]


def _slices(items: DataFrame) -> Iterator[Slice]:
    """Slices of whole items; only one is held on the driver at a time."""
    held: list[tuple[int, bytes]] = []
    rows = items.mapInArrow(_item_terms, "item_id long, term binary").distinct().orderBy("item_id", "term")
    for row in rows.toLocalIterator():
        if len(held) >= SLICE and row["item_id"] != held[-1][0]:
            yield Slice(held)
            held = []
        held.append((row["item_id"], bytes(row["term"])))
    if held:
        yield Slice(held)


POSTED = "doc_id long, n long, terms array<int>, counts array<int>"


def _post(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, long = asked.value.number.get, asked.value.long
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for text in batch.column("text"):
                n, found = 0, Counter()
                for words in term_pieces(text.as_py() or b""):
                    n += len(words)
                    found.update(map(get, map(_name, words) if long else words))
                found.pop(None, None)
                sizes.append(n)
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, documents: int, length: int) -> None:
        self.docs = rows["doc_id"].fill_null(0).to_numpy()
        self.missing = rows["doc_id"].is_null().to_numpy()
        lists = rows["terms"].combine_chunks()
        term, tf = lists.flatten().to_numpy(), rows["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        m = 100 - LENGTH + (LENGTH * rows["n"].to_numpy() * documents) // length
        impact = weights[term] * ((SCALE * tf) // (WEIGHT * tf + SATURATION * m[doc]))
        order = np.lexsort((doc, -impact, term))
        order = order[impact[order] > 0]
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def search(self, terms: np.ndarray, k: int, floor_: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all documents that can be among the k best and score at least `floor_`, scores exact."""
        begin, end = self.at[terms], self.at[terms + 1]
        begin, end = begin[end > begin], end[end > begin]
        at, step = begin.copy(), STEP
        lower = np.zeros(len(self.docs), np.int64)
        while True:
            # The next impact of each list is all that a document not shown by it can still get there.
            following = np.where(at < end, self.impact[np.minimum(at, end - 1)], 0)
            upper = lower + following.sum()
            for first, now, most in zip(begin.tolist(), at.tolist(), following.tolist()):
                if most and now > first:
                    upper[self.doc[first:now]] -= most
            best = lower[lower > 0]
            need = max(floor_, int(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 1)
            if not ((upper >= need) & (upper > lower)).any():
                rows = np.flatnonzero(lower >= need)
                return rows, lower[rows]
            until = np.minimum(at + step, end)
            for now, stop in zip(at.tolist(), until.tolist()):
                lower[self.doc[now:stop]] += self.impact[now:stop]
            at, step = until, 2 * step


FOUND = "item_id long, doc_id long, score long"


def _search(asked, weights: np.ndarray, documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms = asked.value.ids, asked.value.terms
        nothing = np.zeros(0, np.int64)
        best = [(nothing, nothing, nothing.astype(bool))] * len(ids)

        def add(rows: list[pa.RecordBatch]) -> None:
            shard = Shard(pa.Table.from_batches(rows), weights, documents, length)
            for i, own in enumerate(terms):
                scores, docs, missing = best[i]
                row, score = shard.search(own, k, int(scores[-1]) if len(scores) == k else 1)
                if len(row):
                    scores, docs, missing = np.append(scores, score), np.append(docs, shard.docs[row]), np.append(missing, shard.missing[row])
                    top = np.lexsort((docs, missing, -scores))[:k]
                    best[i] = scores[top], docs[top], missing[top]

        held, size, count = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            count += len(batch.column("terms").flatten())
            if size >= DOCS or count >= POSTINGS:
                add(held)
                held, size, count = [], 0, 0
        if held:
            add(held)
        for item, (scores, docs, missing) in zip(ids, best):
            if len(scores):
                columns = [pa.array(np.full(len(scores), item)), pa.array(docs, mask=missing), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    return run


def _searched(spark: SparkSession, rows: DataFrame, part: Slice, k: int) -> DataFrame:
    asked = spark.sparkContext.broadcast(part)
    size = len(part.number)
    posted = stored(rows.mapInArrow(_post(asked), POSTED), "search-posted")
    documents, length = posted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = posted.select("terms").mapInArrow(_frequencies(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(size, np.int64)
    for row in seen.toLocalIterator():  # at most a row for each term of the slice
        weights[row["term"]] = weight(documents, row["df"])
    found = stored(posted.where("n > 0").mapInArrow(_search(asked, weights, documents, length, k), FOUND), "search-found")
    forget(posted)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of `docs` (doc_id, text) for each of `items` (item_id, text): item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores go by ascending doc_id, one without an id last. Missing texts
    and texts without a term take no part; items without an id neither. Rows of `items` that repeat an id
    are one item with the terms of all. Rows of `docs` that repeat an id are ranked each. Other columns
    are ignored; empty tables give an empty result.
    """
    spark = settings(docs.sparkSession)
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    asked = select_only(items, item_id="item_id", text="text").where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    found = None
    for part in _slices(asked):
        one = _searched(spark, rows, part, k)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
SEARCH_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
