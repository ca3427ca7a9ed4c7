"""Benchmark decontamination: BM25 with block-max WAND, then verified overlap (operator 6).

The benchmark items are the indexed side: an inverted index with impact blocks, built on the driver, slice
by slice of the items, and sent to the workers. Every training document is cut into
passages that overlap by the longest item, so each item that a document quotes lies whole within one
passage; each passage queries the index. An item's threshold is the least BM25 score that a text
holding `overlap` of its five-word shingles can have, so retrieval loses nothing that verification
would keep. Larger benchmarks are searched in slices of `SLICE` items, each with an index of its own.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings
from eventlake.llm.words import BASE, SPACE, column_bytes, mix, pieces, span_hashes, spans

SHINGLE, OVERLAP = 5, 0.8
# Items in a block at least, cells of the table of block maxima at most, items in an index.
K1, B, BLOCK, CELLS, SLICE = 1.2, 0.75, 4, 1 << 24, 4000
FACTORS = np.random.default_rng(6).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)

# Words here end at ASCII punctuation too, so that quotes and changed commas don't hide an item.
BREAK = SPACE.copy()
BREAK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def term_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text, and where each text starts."""
    buf, at = column_bytes(column)
    counts, out = np.zeros(len(column), np.int64), []
    for piece, cuts, row, rows in pieces(buf, at):
        if len(piece):
            starts, ends = spans(piece, cuts[cuts < len(piece)], BREAK)
            out.append(span_hashes(piece, starts, ends))
            counts[row : row + rows] += np.diff(np.searchsorted(starts, np.append(cuts, len(piece))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingles(terms: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five terms; of fewer, one for all of them; of none, none."""
    with np.errstate(over="ignore"):
        n = len(terms) - SHINGLE + 1
        if n < 1:
            few = terms * FACTORS[: len(terms)]
            return mix(few.sum(keepdims=True) + np.uint64(len(few)) * np.uint64(BASE)) if len(few) else few
        total = np.zeros(n, np.uint64)
        for i, factor in enumerate(FACTORS):
            total += terms[i : i + n] * factor
        return mix(total)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence or line is its answer, what stands before it the question."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)|\n", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


class Index:
    """Inverted index of the items: for each term its postings by item, in blocks with their largest impact.

    Impacts are BM25 term scores over the item's threshold, so an item is retrieved from a sum of 1.
    """

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP) -> None:
        self.overlap = overlap
        texts = [text or "" for _, text in items]
        terms, at = term_column(pa.array(texts, pa.string()))
        docs = [terms[a:b] for a, b in zip(at[:-1], at[1:])]
        keep = [i for i, d in enumerate(docs) if len(d)]
        self.ids = [items[i][0] for i in keep]
        self.docs = [docs[i] for i in keep]
        self.sets = [np.unique(shingles(d)) for d in self.docs]
        self.longest = max(map(len, self.docs), default=0)
        self.parts = []
        for i in keep:
            pair = term_column(pa.array(question_and_answer(texts[i]), pa.string()))
            self.parts.append([np.unique(shingles(pair[0][pair[1][k] : pair[1][k + 1]])) for k in (0, 1)])
        mean = np.mean([len(d) for d in self.docs]) if self.docs else 1
        seen = Counter(t for d in self.docs for t in set(d.tolist()))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, doc in enumerate(self.docs):
            counts = Counter(doc.tolist())
            impact = {
                t: np.log1p((len(self.docs) - seen[t] + 0.5) / (seen[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(doc) / mean))
                for t, n in counts.items()
            }
            # At most this many shingles are missing, so at most as many positions lie outside all others.
            missing = int((1 - overlap) * len(self.sets[i]) + 1e-9)
            lost = Counter(doc.tolist())
            heaviest = sorted((impact[t] for t in lost for _ in range(lost[t])), reverse=True)[:missing]
            least = max(sum(impact.values()) - sum(heaviest), 1e-3 * sum(impact.values()))
            for t, w in impact.items():
                postings[t].append((i, w / least))
        self.terms = np.array(sorted(postings), np.uint64)
        self.items_of = [np.array([i for i, _ in postings[t]]) for t in self.terms.tolist()]
        self.impacts = [np.array([w for _, w in postings[t]]) for t in self.terms.tolist()]
        self.most = np.array([w.max() for w in self.impacts])
        # Largest impact of each term in each block of items.
        self.block = max(BLOCK, -(-len(self.docs) * len(self.terms) // CELLS))
        self.peaks = np.zeros((len(self.terms), -(-len(self.docs) // self.block)), np.float32)
        for row, (own, impacts) in enumerate(zip(self.items_of, self.impacts)):
            np.maximum.at(self.peaks[row], own // self.block, impacts)

    def retrieve(self, terms: np.ndarray) -> list[int]:
        """Items (by number) whose impacts over the distinct `terms` (numbers in the index) reach 1.

        Block-max WAND: items in blocks whose maxima add up to less than 1 are skipped; in the other
        blocks the terms' largest impacts decide which item comes next.
        """
        live = np.flatnonzero(self.peaks[terms].sum(axis=0) >= 1 - 1e-4)  # the maxima are rounded
        if not len(live):
            return []
        found: list[int] = []
        cursors = [c for c in (self._at(int(t), 0, int(live[0]) * self.block) for t in terms) if c]
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += self.most[t]
                if total >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            block = int(np.searchsorted(live, item // self.block))
            if block == len(live):
                break
            if live[block] != item // self.block:  # no item before the next live block can reach 1
                target, moved = int(live[block]) * self.block, [c for c in cursors if c[0] < int(live[block]) * self.block]
            elif cursors[0][0] == item:
                same = [c for c in cursors if c[0] == item]
                if sum(self.impacts[t][at] for _, at, t in same) >= 1 - 1e-9:
                    found.append(item)
                target, moved = item + 1, same
            else:
                target, moved = item, [c for c in cursors if c[0] < item]
            rest = cursors[len(moved) :]
            cursors = rest + [c for c in (self._at(t, at, target) for _, at, t in moved) if c]
        return found

    def _at(self, term: int, at: int, item: int) -> tuple[int, int, int] | None:
        """Cursor of a term at its first posting from `at` on that has at least this item."""
        own = self.items_of[term]
        at += int(np.searchsorted(own[at:], item))
        return (int(own[at]), at, term) if at < len(own) else None

    def matches(self, terms: np.ndarray) -> dict[int, tuple[float, float, float]]:
        """Verified items of a document: item number -> best overlap of the whole, its question, its answer."""
        if not len(self.terms) or not len(terms):
            return {}
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        weight = np.concatenate([[0.0], np.cumsum(np.where(known, self.most[at], 0))])
        step = self.longest
        begin = np.arange(0, max(len(terms) - step, 1), step)
        end = np.minimum(begin + 2 * step, len(terms))
        best: dict[int, tuple[float, float, float]] = {}
        for a, b in zip(begin, end):
            if weight[b] - weight[a] < 1 - 1e-9:  # even all items' largest impacts are too little
                continue
            passage = np.unique(at[a:b][known[a:b]])
            held = None
            for item in self.retrieve(passage):
                held = np.unique(shingles(terms[a:b])) if held is None else held
                whole = _share(self.sets[item], held, terms[a:b], self.docs[item])
                if whole >= self.overlap - 1e-12:
                    parts = [_share(p, held, None, None) for p in self.parts[item]]
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (whole, *parts))
        return best


def _share(own: np.ndarray, held: np.ndarray, terms: np.ndarray | None, doc: np.ndarray | None) -> float:
    if not len(own):
        return 1.0
    if doc is not None and len(doc) < SHINGLE:  # one run of fewer words: look for it as such
        n = len(doc)
        return float(any((terms[i : i + n] == doc).all() for i in range(len(terms) - n + 1)))
    return len(np.intersect1d(own, held, assume_unique=True)) / len(own)


def _indexes(benchmark: DataFrame, overlap: float) -> list[Index]:
    """Indexes of slices of the items; a benchmark is a small table, each slice's index some tens of MB at most."""
    items = select_only(benchmark, item_id="item_id", text="text").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    rows = items.where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator()
    out, held = [], []
    for row in rows:
        held.append((row["item_id"], row["text"]))
        if len(held) == SLICE:
            out.append(Index(held, overlap))
            held = []
    return out + ([Index(held, overlap)] if held else [])


MATCHES = "doc_id long, item_id long, overlap double, question_overlap double, answer_overlap double"


def _match(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, at = term_column(batch.column("text"))
            rows = [
                (doc, index.ids[item], *shares)
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:])
                for item, shares in sorted(index.matches(terms[a:b]).items())
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in MATCHES.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Verified quotes of items in `docs` (doc_id, text): doc_id, item_id and the shares of shingles found.

    A quote has at least `overlap` of the item's five-word shingles within one passage. Items and texts
    that are missing or without a word match nothing; repeated rows are matched each; other columns are
    ignored. Items of fewer than five words must be found as they are.
    """
    settings(docs.sparkSession)
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for index in _indexes(benchmark, overlap):
        part = rows.mapInArrow(_match(index), MATCHES)
        found = part if found is None else found.union(part)
    return found if found is not None else rows.limit(0).select("doc_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in MATCHES.split(", ")[1:]])


def _clean(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, at = term_column(batch.column("text"))
            yield batch.filter(pa.array([not index.matches(terms[a:b]) for a, b in zip(at[:-1], at[1:])], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs` that quote no item, with all their columns, whatever their names.

    Missing and empty texts quote nothing and stay; repeated rows are judged alike; an empty table or benchmark
    takes nothing away.
    """
    settings(docs.sparkSession)
    for index in _indexes(benchmark, overlap):
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs
