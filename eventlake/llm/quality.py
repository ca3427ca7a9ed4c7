"""Quality classifier: regularised quadratic discriminant over document statistics (operator 9).

Each document becomes `FEATURES` transformed statistics of its bytes and words. The two classes' means
and covariances come from sums that Spark adds up over the labelled rows; each covariance is shrunk
towards the pooled one and to its diagonal. A score is the logistic value of the difference of the two
log densities, read off Mahalanobis distances with Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import select_only, settings, stored
from eventlake.llm.words import column_bytes, column_words

THRESHOLD, SHRINK, RIDGE = 0.7, 0.3, 0.05
FEATURES = ("words", "word_length", "upper", "digit", "stop", "symbol", "distinct", "repeat", "commonest", "line")
SCHEMA = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)

# Kinds of bytes counted: A-Z, 0-9, sentence signs, other ASCII signs, line ends, and all but white space.
_KINDS = np.zeros((6, 256), np.float64)
_KINDS[0, ord("A") : ord("Z") + 1] = 1
_KINDS[1, ord("0") : ord("9") + 1] = 1
_KINDS[2, list(b".,;:'\"-()?")] = 1
_KINDS[3, list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 1
_KINDS[4, ord("\n")] = 1
_KINDS[5, 33:] = 1


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; shares are taken to the square root."""
    buf, at = column_bytes(column)
    hashes, begin = column_words(column)
    out = np.zeros((len(column), len(FEATURES)))
    for i in range(len(column)):
        upper, digit, stop, symbol, lines, solid = _KINDS @ np.bincount(buf[at[i] : at[i + 1]], minlength=256)
        words = hashes[begin[i] : begin[i + 1]]
        n, solid = len(words), max(solid, 1)  # words of control characters alone
        if n:
            kinds, counts = np.unique(words, return_counts=True)
            again = np.count_nonzero(words[1:] == words[:-1]) / (n + 10)
            # A long text repeats words anyway: compare the number of different words with a power of all.
            distinct = np.log(len(kinds)) / np.log(n) if n > 1 else 1.0
            most = counts.max() / (n + 10)
            out[i] = (
                min(np.log1p(n), 7), np.log(solid / n), *np.sqrt([upper / solid, digit / solid, stop / solid, symbol / solid]),
                distinct, np.sqrt(again), np.sqrt(most), np.sqrt(lines / (n + 10)),
            )
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = statistics(batch.column("text")).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *FEATURES])


def document_statistics(docs: DataFrame) -> DataFrame:
    rows = select_only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_statistics, SCHEMA)


class Discriminant:
    """Means, Cholesky factors and log shares of the two classes; two matrices of 10 by 10 to send."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        n = {k: sums[k][0] if k in sums else 0 for k in (0, 1)}
        self.share = (n[1] + 1) / (n[0] + n[1] + 2)
        self.fitted = min(n.values()) > 0
        if not self.fitted:
            return
        mean = {k: sums[k][1] / n[k] for k in n}
        spread = {k: sums[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in n}
        pooled = sum(n[k] * spread[k] for k in n) / sum(n.values())
        scale = np.sqrt(np.clip(np.diag(pooled), 1e-8, None))
        self.scale, self.mean, self.factor, self.log = scale, {}, {}, {}
        for k in n:
            own = ((1 - SHRINK) * spread[k] + SHRINK * pooled) / np.outer(scale, scale)
            self.factor[k] = np.linalg.inv(np.linalg.cholesky(own + RIDGE * np.eye(len(scale))))
            self.mean[k] = mean[k]
            self.log[k] = np.log(np.diag(self.factor[k])).sum() + np.log(n[k])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        density = {k: self.log[k] - (((x - m) / self.scale @ self.factor[k].T) ** 2).sum(axis=1) / 2 for k, m in self.mean.items()}
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fold(doc_id, folds: int = 4):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def held_out(doc_id):
    return fold(doc_id) == 2


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled documents that are not held out; labels other than 0 and 1 don't count."""
    marks = select_only(labels, doc_id="doc_id", quality="quality").where("quality IN (0, 1)")
    marks = marks.select(F.col("doc_id").cast("long"), "quality").where(~held_out(F.col("doc_id")))
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    sums = (
        stats.join(marks, "doc_id")
        .groupBy("quality")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f).alias(f) for f in FEATURES],
            *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs],
        )
    )
    found = {}
    for row in sums.collect():
        square = np.array([[row[f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}"] for b in FEATURES] for a in FEATURES])
        found[row["quality"]] = row["n"], np.array([row[f] for f in FEATURES]), square
    return Discriminant(found)


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    A missing or empty text has all statistics 0 and is scored like any other. Repeated rows are scored
    each; so are rows without an id, which are never trained on. With one class or none among the labels
    every score is the smoothed share of label 1. Other columns are ignored.
    """
    settings(docs.sparkSession)
    stats = stored(document_statistics(docs), "quality")
    scored = stats.mapInArrow(_scored(fit(stats, labels)), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def _keep(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(statistics(batch.column("text"))) >= THRESHOLD))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns, whatever their names.

    Missing and empty texts are scored like others; repeated rows are judged alike. An empty table gives an
    empty result.
    """
    settings(docs.sparkSession)
    stats = stored(document_statistics(docs), "quality")
    return docs.mapInArrow(_keep(fit(stats, labels)), docs.schema)
