"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from labels of documents.

A sentence's score is the logistic of a bias and the weights of its words and word beginnings; a document's is 1 less the product
of what its sentences leave, so it is toxic as soon as one sentence is. The weights follow the gradient of the document labels'
likelihood through the noisy-or, and afterwards single out the sentences that made a document toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, staged, unit
from .quality import chosen, held_out, labelled
from .textvec import NOT_ALNUM, buffer, hashes, mix, words

#: Labelled documents that a fit reads at most, bytes of one and of all of them (longer ones and the rest aren't learnt from, but scored
#: whole like any others), features that it keeps, and documents that a feature must be in.
FIT_ROWS = 10_000
FIT_ROW_BYTES, FIT_BYTES = 1 << 20, 64 << 20
FEATURES = 4_000
LEAST = 4
#: Standard deviations that a feature's log odds must be from 0; among some 100,000 features few get there by chance.
SURE = 3.5
#: Bytes of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
STEPS, RATE, DECAY = 400, 0.1, 3e-5
_STOP = np.isin(np.arange(256), list(b".!?\n"))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the words, then of their beginnings of each length; 0 where a word is no longer than that."""
    yield hashes(data, starts, ends)
    for k in PREFIXES:
        longer = ends - starts > k
        h = mix(hashes(data, starts, np.minimum(ends, starts + k)) + np.uint64(k))
        yield np.where(longer, h, np.uint64(0))


def sentences(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence number of each word, and each document's first sentence; sentences without words don't count."""
    stops = np.cumsum(_STOP[data])[starts] if len(starts) else np.empty(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = stops[1:] != stops[:-1]
    new[first[:-1][first[:-1] < len(starts)]] = True
    number = np.cumsum(new) - 1
    total = int(number[-1]) + 1 if len(number) else 0
    begins = np.append(number, total)[first]
    return number, begins


@dataclass
class Model:
    """Sorted feature hashes, their weights, the bias, and a bit table that turns most other hashes away."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``h`` a feature stands, and which."""
        i = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(i) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h[i]), len(self.keys) - 1)
        hit = self.keys[k] == h[i]
        return i[hit], k[hit]

    def within(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentences and the features that stand in them, each pair once, by sentence."""
        where, which = zip(*(self.find(h) for h in features(data, starts, ends)), strict=True)
        pairs = np.unique(number[np.concatenate(where)].astype(np.int64) << 32 | np.concatenate(which))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Scores and numbers of sentences of the documents, log odds of the sentences, and where all that stands."""
        data, offsets = buffer(column)
        starts, ends, first = words(data, offsets, NOT_ALNUM)
        number, begins = sentences(data, offsets, starts, first)
        z = np.full(int(begins[-1]) if len(begins) else 0, self.bias)
        at, k = self.within(data, starts, ends, number)
        z += np.bincount(at, self.weights[k], minlength=len(z))
        left = -np.logaddexp(0, z)
        total = np.concatenate(([0.0], np.cumsum(left)))
        n = np.diff(begins)
        return 1 - np.exp(total[begins[1:]] - total[begins[:-1]]), n, z, (data, offsets, starts, ends, number, begins)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature, documents of label 1 with it, documents of label 0 with it; one row for each feature of a slice."""
    for batch in batches:
        for part in pieces(batch, 0):
            data, offsets = buffer(part.column(0))
            starts, ends, first = words(data, offsets, NOT_ALNUM)
            keys, rows = [], []
            for h in features(data, starts, ends):
                for d in range(part.num_rows):
                    u = np.unique(h[first[d] : first[d + 1]])
                    keys.append(u)
                    rows.append(np.full(len(u), d))
            keys, rows = np.concatenate(keys), np.concatenate(rows)
            keys, rows = keys[keys != 0], rows[keys != 0]
            label = part.column(1).to_numpy(zero_copy_only=False)[rows]
            u, back = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, label == 1, len(u)).astype(np.int64)), pa.array(np.bincount(back, label == 0, len(u)).astype(np.int64))], names=["h", "p", "n"])


def _instances(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Label, number of sentences, and the features that stand in them, a document each."""
        for batch in batches:
            for part in pieces(batch, 0):
                data, offsets = buffer(part.column(0))
                starts, ends, first = words(data, offsets, NOT_ALNUM)
                number, begins = sentences(data, offsets, starts, first)
                at, k = model.within(data, starts, ends, number)
                cut = np.searchsorted(at, begins)
                rows = [(at[a:b] - s, k[a:b]) for a, b, s in zip(cut[:-1], cut[1:], begins[:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(begins)), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["label", "n", "at", "k"])

    return run


def fit(keys: np.ndarray, start: np.ndarray, labels: np.ndarray, counts: np.ndarray, at: list, which: list) -> Model:
    """Weights and bias by Adam on the noisy-or likelihood of the documents' labels; sentences without a feature share one term."""
    sizes = np.array([len(x) for x in at], int)
    doc = np.repeat(np.arange(len(labels)), sizes)
    place = np.concatenate([np.asarray(x, np.int64) for x in at]) if len(at) else np.empty(0, np.int64)
    k = np.concatenate([np.asarray(x, np.int64) for x in which]) if len(which) else np.empty(0, np.int64)
    pairs, sent = np.unique(doc.astype(np.int64) << 32 | place, return_inverse=True)
    owner = pairs >> 32
    plain = counts - np.bincount(owner, minlength=len(labels))
    w, b = start * 0.3, -6.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    y = labels.astype(float)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sent, w[k], minlength=len(pairs))
        p = 1 / (1 + np.exp(-z))
        p0 = 1 / (1 + np.exp(-b))
        left = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + plain * np.log1p(-p0)
        none = np.clip(np.exp(left), 1e-9, 1 - 1e-9)
        pull = (y * none / (1 - none) - (1 - y)) / max(1, len(y))
        pull = np.clip(pull, -50 / max(1, len(y)), 50 / max(1, len(y)))
        gz = -pull[owner] * p
        grad = np.append(np.bincount(k, gz[sent], minlength=len(w)) + DECAY * w, gz.sum() - (pull * plain).sum() * p0)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, b = w - move[:-1], min(b - move[-1], -3.0)
    return Model(keys, w, float(b))


def _sample(docs: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """``text, label`` of at most about ``FIT_ROWS`` labelled documents of the learning folds and ``FIT_BYTES``, by seeded hashes of their ids; of rows that share an id, one."""
    known = chosen(labelled(docs, labels, "toxic"), FIT_ROWS, 21)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= FIT_ROW_BYTES)
    rows = staged(rows.join(F.broadcast(known), "_id").groupBy("_id", "label").agg(F.min("text").alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > FIT_BYTES:
        rows = rows.filter(unit(F.lit(22), "_id") < 0.97 * FIT_BYTES / size)
    return rows.select("text", "label")


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """A model from a bounded sample; what reaches the driver are the sample's sentences that hold a feature, at most 64 bytes for each byte of ``FIT_BYTES`` if every word were one."""
    sample = _sample(docs, labels, text, key)
    totals = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    pos, neg = int(totals[0] or 0), int(totals[1] or 0) - int(totals[0] or 0)
    counts = sample.mapInArrow(_counted, "h long, p long, n long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter(F.col("p") + F.col("n") >= LEAST)
    a, c = (F.col("p") + 0.5) / (pos + 1), (F.col("n") + 0.5) / (neg + 1)
    ratio = F.log(a / c)
    deviation = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    best = counts.select("h", ratio.alias("w"), F.abs(ratio / deviation).alias("z")).filter(F.col("z") >= SURE).orderBy(F.desc("z"), "h").limit(FEATURES).collect()
    keys = np.array([r.h for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    start = np.array([r.w for r in best], float)[order]
    blank = Model(keys[order], start, 0.0)
    rows = sample.mapInArrow(_instances(blank), "label int, n long, at array<long>, k array<long>").collect()
    return fit(blank.keys, start, np.array([r.label for r in rows], int), np.array([r.n for r in rows], int), [r.at for r in rows], [r.k for r in rows])


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, offending`` of each row.

    ``offending``: code point spans and scores of the sentences that score 1/2 or more. A null, empty or wordless text has no
    sentence and score 0. Repeated rows score alike; an empty table, or one without labels, works. Texts are not shuffled.
    """
    ship(docs.sparkSession)
    model = model or trained(docs, labels, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                score, n, z, (data, offsets, starts, ends, number, begins) = model.score(part.column(1))
                # code points before each byte, so that a span costs no more than its two ends
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for s in np.flatnonzero(z >= 0):
                    d = int(np.searchsorted(begins, s, "right")) - 1
                    a, b = np.searchsorted(number, [s, s + 1])
                    base = points[offsets[d]]
                    found[d].append({"start": int(points[starts[a]] - base), "end": int(points[ends[b - 1]] - base), "score": float(1 / (1 + np.exp(-z[s])))})
                spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0.0, 1.0)), pa.array(n), pa.array(found, spans)], names=["doc_id", "score", "n_sentences", "offending"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "offending")
