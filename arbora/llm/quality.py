"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are shares of bytes, words and lines of the whole text, so neither a long nor a short text stands out by its length;
``asinh`` spreads their small values. Each class has a mean and a covariance shrunk towards the pooled one and its diagonal; a
score is the logistic of the difference of the two Gaussian log densities and prior odds, both Mahalanobis distances by triangular
solves with Cholesky factors computed once. Labels hold noise, so the fit is repeated without the rows of each class that lie
farthest inside the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, staged, unit
from .textvec import SPACE, buffer, hashes, words

#: Labelled rows that a fit reads at most, by a seeded hash.
FIT_ROWS = 20_000
THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.3, 0.1, 0.02
ROUNDS = 3
#: Words that each text counts as having besides its own, so that a few odd ones don't mark a short text.
EASE = 10

FEATURES = ["upper", "marks", "bars", "calls", "digits", "repeats", "distinct", "word_bytes", "marked_words", "line_repeats"]
_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_MARK = np.isin(np.arange(256), list(rb"#$%&*<>{}[]\^~=_`|@"))
_CALL = np.isin(np.arange(256), list(b"!?"))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _fresh(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different hashes in each document."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.empty(0, bool)
    return np.bincount(owner[new], minlength=len(first) - 1).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; an empty text has all shares 0."""
    data, offsets = buffer(column)
    n = np.maximum(np.diff(offsets), 1).astype(float)
    starts, ends, first = words(data, offsets)
    count = np.diff(first).astype(float)
    many = np.maximum(count, 1)
    h = hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    is_mark = _MARK[data] | _CALL[data]
    marks = np.concatenate(([0], np.cumsum(is_mark)))
    lines, line_ends, line_first = words(data, offsets, np.arange(256) == 10)
    n_lines = np.maximum(np.diff(line_first), 1)
    line_hash = hashes(data, lines, line_ends)
    spaces = _sums(SPACE[data], offsets)
    share = lambda x: np.arcsinh(50 * x)
    return np.stack(
        [
            share(_sums(_UPPER[data], offsets) / np.maximum(_sums(_LETTER[data], offsets), 1)),
            share(_sums(_MARK[data], offsets) / n),
            share(_sums(data == 124, offsets) / (many + EASE)),
            share(_sums(_CALL[data], offsets) / n),
            share(_sums(_DIGIT[data], offsets) / n),
            share(_sums(same, first) / (many + EASE)),
            np.log((_fresh(h, first) + EASE) / (many + EASE)),
            np.log1p((n - spaces) / many),
            share(_sums(marks[ends] > marks[starts], first) / (many + EASE)),
            share(1 - _fresh(line_hash, line_first) / n_lines) * (np.diff(line_first) > 1),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior odds of class 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    odds: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, plus the log odds."""
        dist = [((x - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
        density = [-0.5 * (d * d).sum(axis=1) - 0.5 * det for d, det in zip(dist, self.log_dets, strict=True)]
        return density[1] - density[0] + self.odds

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Discriminant:
    """Fit on all rows, then again without those whose label the model gives less than 1 % (noise in the labels).

    A class without rows takes the other's shape around the mean of all; without any row every score is 1/2.
    """
    d = x.shape[1]
    keep = np.ones(len(y), bool)
    model = None
    for _ in range(rounds):
        groups = [x[keep & (y == k)] for k in (0, 1)]
        known = [g for g in groups if len(g)]
        pooled = sum(((g - g.mean(0)).T @ (g - g.mean(0)) for g in known), np.zeros((d, d))) / max(1, sum(map(len, known)))
        means, factors, dets = [], [], []
        for g in groups:
            centre = g.mean(0) if len(g) else (x.mean(0) if len(x) else np.zeros(d))
            own = (g - centre).T @ (g - centre) / len(g) if len(g) > 1 else pooled
            s = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + FLOOR * np.eye(d)
            low = np.linalg.cholesky(s)
            means.append(centre)
            factors.append(np.linalg.inv(low))
            dets.append(2 * float(np.log(np.diag(low)).sum()))
        model = Discriminant(means, factors, dets, float(np.log((len(groups[1]) + 1) / (len(groups[0]) + 1))))
        p = model.score(x) if len(x) else np.empty(0)
        keep = np.where(y == 1, p, 1 - p) >= 0.01
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """``_id, label`` of the rows that may be learnt from: a label of 0 or 1, and crc32(id as text) mod ``folds`` not 0. Of an id's several labels the largest counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    return rows.groupBy("_id").agg(F.max("label").alias("label")).filter(~held_out("_id", folds))


def chosen(known: DataFrame, rows: int, seed: int) -> DataFrame:
    """``known``, or about ``rows`` of its rows by a seeded hash of their ids: each worker picks its own, nothing is sorted."""
    n = known.count()
    return known if n <= rows else known.filter(unit(F.lit(seed), "_id") < 0.97 * rows / n)


def held_out(key: str, folds: int = 5):
    """Whether crc32(id as text) mod ``folds`` is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, x``: the transformed statistics of each row's text, in the order of ``FEATURES``."""
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>")


def trained(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Discriminant:
    """A discriminant from at most ``rows`` labelled documents; their statistics alone go to the driver, 80 bytes each."""
    known = chosen(labelled(stats, labels, "quality"), rows, 11).withColumnRenamed("_id", "doc_id")
    found = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()  # of rows that share an id, one
    x = np.array([r.x for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r.label for r in found], int))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted, statistics`` of each row. Texts are read once: statistics are staged, fitted on and scored.

    Null and empty texts have all shares 0 and are scored by that. Repeated rows get equal scores; an empty table or one without
    labels works, the latter with scores of 1/2.
    """
    stats = staged(document_statistics(docs, text, key))
    model = trained(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), b.column(1)], names=["doc_id", "score", "statistics"])

    scored = stats.mapInArrow(score, "doc_id long, score double, statistics array<double>")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "statistics")


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be of quality, with all their columns; texts are not shuffled.

    Null and empty texts are judged by their shares, which are 0. An empty table stays empty, one without labels stays whole, and
    rows that share an id are each judged by their own text.
    """
    most = chosen(labelled(docs, labels, "quality"), FIT_ROWS, 11).select("_id")
    sample = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(most), "_id")
    model = trained(staged(document_statistics(sample, "_text", "_id")), labels)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array(model.score(statistics(part.column(at))) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
