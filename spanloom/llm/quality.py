"""Quality scores by Bradley-Terry pairwise ranking.

Documents marked good and bad give preference pairs.  A linear score is learned
by logistic loss on the differences of their features, log(1 + exp(-w.(x - y))),
with full gradients in numpy.  The score is then cut at a quantile: that of the
training scores that tells good from bad best; a logistic scale maps this cut to
``CUT``.  All features are computed over the whole text.

The learner sees at most ``max_rows`` labelled rows (those least by a hash of
doc_id), of which at most ``max_pairs`` pairs are drawn: a documented bound.  All
documents are scored.

Edge cases: null and empty texts have all counts 0 and get the score of that;
without both labels in the training rows every score is 0.5, as with empty tables of
labels; an empty table of documents gives an empty one.  Rows that repeat a doc_id are scored
each by its own text, and one of them (least label, then features) is learned from.  Of several
cuts that err as little, the middle is taken; a score that ties with the cut passes.
Other columns are never read and come through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, texthash

CUT, MAX_ROWS, MAX_PAIRS = 0.3, 12_000, 40_000

_CLASSES = ["lower", "upper", "digit", "high", "space", "newline", "stop", "bang", "pipe", "hash", "percent", "dollar", "amp", "star", "control", "other"]
_CLASS = np.full(256, 15, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _k, _chars in ((4, b" \t"), (5, b"\n"), (6, b".,;:"), (7, b"!?"), (8, b"|"), (9, b"#"), (10, b"%"), (11, b"$"), (12, b"&"), (13, b"*")):
    _CLASS[list(_chars)] = _k
_CLASS[:9] = _CLASS[14:32] = 14


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each document of a chunk."""
    n = len(offsets) - 1
    part = data[int(offsets[0]) : int(offsets[-1])]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 16 + _CLASS[part], minlength=n * 16).reshape(n, 16).astype(float)
    words, doc, starts, ends = texthash.word_hashes(data, offsets)
    total = np.bincount(doc, minlength=n).astype(float)
    safe, bytes_ = np.maximum(total, 1), np.maximum(size, 1)[:, None]
    again = np.bincount(doc[1:], weights=(words[1:] == words[:-1]) & (doc[1:] == doc[:-1]), minlength=n) if len(doc) else np.zeros(n)
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=n)
    run = np.diff(np.append(np.flatnonzero(fresh), len(w)))
    top = np.zeros(n)
    np.maximum.at(top, d[fresh], run)
    last = _CLASS[part[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    symbol = np.bincount(doc, weights=last >= 7, minlength=n)
    bare = np.bincount(doc, weights=(ends - starts == 1) & (last >= 7), minlength=n)
    lengths = np.bincount(doc, weights=ends - starts, minlength=n) / safe
    shares = counts / bytes_
    ratio = distinct / safe
    columns = [
        *np.sqrt(shares).T, *(shares[:, [1, 7, 8, 15]] > 0.02).T.astype(float),
        again / safe, np.sqrt(again / safe), ratio, ratio * np.log1p(total), top / safe, np.log1p(top),
        symbol / safe, np.sqrt(symbol / safe), bare / safe, np.minimum(lengths, 40) / 10, (lengths > 12).astype(float),
        np.log1p(total), np.log1p(size), total == 0, total < 5, total < 20, np.log1p(counts[:, 5]), np.log1p(total / (1 + counts[:, 5])),
        counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1), counts[:, 9:14].sum(axis=1) / bytes_[:, 0],
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


@dataclass
class Ranking:
    """A learned score: sigmoid(scale * (w.((x - mean) / std) - cut) + logit(CUT))."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.std).clip(-8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.cut) + np.log(CUT / (1 - CUT)), -60, 60)))


def fit(x: np.ndarray, good: np.ndarray, max_pairs: int = MAX_PAIRS, steps: int = 250, decay: float = 1e-3) -> Ranking | None:
    """Bradley-Terry weights from pairs (good, bad), then the best score quantile."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return None
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / std).clip(-8, 8)
    rng = np.random.default_rng(7)
    pairs = min(max_pairs, len(a) * len(b))
    first, second = rng.choice(a, pairs), rng.choice(b, pairs)
    delta = z[first] - z[second]
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(delta @ w, -60, 60)))
        g = -(delta.T @ p) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    raw = z @ w
    grid = np.unique(np.quantile(raw, np.linspace(0.002, 0.998, 500)))
    wrong = [((raw < q) & good).sum() + ((raw >= q) & ~good).sum() for q in grid]
    best = np.flatnonzero(np.array(wrong) == min(wrong))
    cut = float((grid[best[0]] + grid[best[-1]]) / 2)
    spread = max(float(np.std(raw)), 1e-6)
    scale = 4 / spread
    return Ranking(mean, std, w, cut, scale)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = MAX_ROWS) -> Ranking | None:
    """Learns from labels (doc_id, quality) of ``docs``; ``allowed``: a condition on doc_id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    if allowed is not None:
        known = known.where(allowed)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.as_bytes(batch.column(1))
            for lo, hi in texthash.chunks(offsets):
                x = features(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    seen = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(scratch.lean(run), "doc_id long, quality int, x array<double>")
    one = seen.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*")  # of an id's rows one
    found = one.limit(max_rows).toPandas().sort_values("doc_id")
    if found.empty:
        return None
    return fit(np.array(found["x"].tolist()), found["quality"].to_numpy() > 0)


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.as_bytes(batch.column(1))
            for lo, hi in texthash.chunks(offsets):
                s = model.score(features(data, offsets[lo : hi + 1])) if model else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scratch.lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Ranking | None, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``cut``, by one pass over the rows."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.as_bytes(batch.column(place))
            for lo, hi in texthash.chunks(offsets):
                s = model.score(features(data, offsets[lo : hi + 1])) if model else np.full(hi - lo, 0.5)
                yield batch.slice(lo, hi - lo).filter(pa.array(s >= cut))

    return docs.mapInArrow(scratch.lean(run), docs.schema)


def score_quantile(scores: DataFrame, share: float, accuracy: int = 10_000) -> float:
    """The score below which ``share`` of all rows lie."""
    found = scores.agg(F.percentile_approx("score", share, accuracy)).first()[0]
    return 0.0 if found is None else float(found)
