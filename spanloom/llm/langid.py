"""Language identification by a bidirectional GRU over bytes, trained in numpy.

A text is read as windows: its words (runs of non-space bytes, A-Z as a-z),
words of more than ``WINDOW`` bytes in pieces.  The network reads each window in
both directions and labels every byte position with a probability for each
language; a document's probabilities are the mean over all its positions.  As
the network's state starts anew in each window, a window that occurs often is
computed once for each chunk of documents and weighted by its count.

Training is backpropagation through time with Adam on a bounded sample:
``max_rows`` documents (least by a hash of doc_id) and ``max_windows`` of their
windows.  Every document is predicted from its whole text.

Edge cases: text that is null or has no letter is ``und`` with score 0; if there
is nothing to learn from, every text is.  Rows that repeat a doc_id are judged each by its own
text, and one of them (least language, then text) is learned from.  Languages of equal
probability: the first in alphabetical order.  An empty table gives an empty one.  Other columns
are not read, whatever their names.  The sample to learn from is bounded: ``max_rows`` documents
of ``max_chars`` characters each; what is predicted is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, texthash

WINDOW, HIDDEN, MAX_ROWS, MAX_WINDOWS, MAX_CHARS = 24, 12, 3_000, 60_000, 20_000
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One GRU: byte table (256 x 3H, inputs and biases of gates z, r, n) and recurrence (H x 3H)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.table = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.back = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, B, H) for bytes x (T, B); with ``keep`` what backward needs."""
        n, k = x.shape[1], self.h
        h, states, past = np.zeros((n, k), np.float32), np.empty((*x.shape, k), np.float32), []
        for t in range(len(x)):
            a, u = self.table[x[t]], h @ self.back
            gates = _sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            new = c + z * (h - c)
            if keep:
                past.append((h, z, r, c, u[:, 2 * k :]))
            states[t] = h = new
        return states, past

    def backward(self, x: np.ndarray, d_states: np.ndarray, past: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recurrence, through time from the last step to the first."""
        k = self.h
        g_table, g_back = np.zeros_like(self.table), np.zeros_like(self.back)
        d_h = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, un = past[t]
            d = d_states[t] + d_h
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (h - c) * z * (1 - z)
            d_r = d_c * un * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_c], axis=1)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(g_table, x[t], d_a)
            g_back += h.T @ d_u
            d_h = d * z + d_u @ self.back.T
        return g_table, g_back


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray
    bias: np.ndarray

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, languages) of every position of windows x (T, B)."""
        f, _ = self.ahead.forward(x)
        b, _ = self.behind.forward(x[::-1])
        logits = np.concatenate([f, b[::-1]], axis=2) @ self.out + self.bias
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def params(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.back, self.behind.table, self.behind.back, self.out, self.bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions and its gradients; y: the language of each window."""
        f, past_f = self.ahead.forward(x, True)
        b, past_b = self.behind.forward(x[::-1], True)
        both = np.concatenate([f, b[::-1]], axis=2)
        logits = both @ self.out + self.bias
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        n = x.shape[0] * x.shape[1]
        rows = np.arange(x.shape[1])
        loss = float(-np.log(p[:, rows, y] + 1e-9).mean())
        d = p
        d[:, rows, y] -= 1
        d /= n
        flat = d.reshape(-1, d.shape[2])
        g_out, g_bias = both.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        d_both = d @ self.out.T
        k = self.ahead.h
        g_f = self.ahead.backward(x, d_both[:, :, :k], past_f)
        g_b = self.behind.backward(x[::-1], d_both[::-1, :, k:], past_b)
        return loss, [*g_f, *g_b, g_out, g_bias]


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    out = (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32)
    return Network(languages, Direction(hidden, rng), Direction(hidden, rng), out, np.zeros(len(languages), np.float32))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the chunk, document, start, end) of each window."""
    part = data[int(offsets[0]) : int(offsets[-1])]
    _, doc, starts, ends = texthash.word_hashes(data, offsets)
    pieces = -(-(ends - starts) // WINDOW)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        doc, stop = np.repeat(doc, pieces), np.repeat(ends, pieces)
        starts = np.repeat(starts, pieces) + nth * WINDOW
        ends = np.minimum(starts + WINDOW, stop)
    return part, doc, starts, ends


def chunk_probabilities(model: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions of each document (0 without any)."""
    part, doc, starts, ends = windows(data, offsets)
    n, k = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, k))
    if not len(doc):
        return out
    keys = texthash.span_hashes(part, starts, ends)
    _, at, which = np.unique(keys, return_index=True, return_inverse=True)
    first, length = starts[at], (ends - starts)[at]
    sums = np.zeros((len(at), k), np.float32)
    folded = _LOWER[part]
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        for lo in range(0, len(rows), 4096):
            some = rows[lo : lo + 4096]
            x = folded[first[some][None, :] + np.arange(size)[:, None]]
            sums[some] = model.positions(x).sum(axis=0)
    for c in range(k):
        out[:, c] = np.bincount(doc, weights=sums[which, c], minlength=n)
    places = np.bincount(doc, weights=ends - starts, minlength=n)
    return out / np.maximum(places, 1)[:, None]


def fit(texts: list[str], languages: list[str], max_windows: int = MAX_WINDOWS, epochs: int = 4, hidden: int = HIDDEN) -> Network | None:
    """Trains on the windows of ``texts``, each position labelled by its text's language."""
    names = sorted(set(languages))
    if not names:
        return None
    model = new_network(names, hidden)
    rng = np.random.default_rng(11)
    data, offsets = texthash.as_bytes(pa.array(texts, pa.string()))
    part, doc, starts, ends = windows(data, offsets)
    if not len(doc):
        return None
    label = np.array([names.index(x) for x in languages])[doc]
    # as many windows of each language, in the languages' own order of words
    share = max(1, max_windows // len(names))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == c))[:share] for c in range(len(names))])
    starts, label, length = starts[chosen], label[chosen], (ends - starts)[chosen]
    folded = _LOWER[part]
    params = model.params()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        batches = []
        for size in np.unique(length):
            rows = rng.permutation(np.flatnonzero(length == size))
            batches += [(size, rows[i : i + 256]) for i in range(0, len(rows), 256)]
        rate = 0.01 * (1 - epoch / epochs)
        for b in rng.permutation(len(batches)):
            size, rows = batches[b]
            x = folded[starts[rows][None, :] + np.arange(size)[:, None]]
            _, grads = model.gradients(x, label[rows])
            step += 1
            weight = min(1.0, len(rows) / 64)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g * weight
                v *= 0.999
                v += 0.001 * (g * weight) ** 2
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, allowed: Column | None = None, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, **options) -> Network | None:
    """Learns from (text, lang) of a bounded sample of ``docs``; ``allowed``: a condition on doc_id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("doc_id is not null and lang is not null and text is not null")
    if allowed is not None:
        known = known.where(allowed)
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # the sample is drawn by id first, so that texts are not sorted
    # the sample is drawn by id first, so that whole texts are not sorted; of an id's rows one is taken,
    # and what comes to the driver has at most max_rows * max_chars characters
    cut = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", F.substring("text", 1, max_chars).alias("text"))
    rows = cut.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*").limit(max_rows).toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["lang"].tolist(), **options) if len(rows) else None


def predict(docs: DataFrame, model: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.as_bytes(batch.column(1))
            for lo, hi in texthash.chunks(offsets, 4 << 20):  # more windows repeat in a longer chunk
                ids = batch.column(0).slice(lo, hi - lo)
                texts = batch.column(1).slice(lo, hi - lo)
                lettered = np.array([t is not None and _LETTER.search(t) is not None for t in (s.as_py() for s in texts)], bool)
                if model is None:
                    names, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                else:
                    p = chunk_probabilities(model, data, offsets[lo : hi + 1])
                    names = [model.languages[i] if ok else "und" for i, ok in zip(p.argmax(axis=1), lettered, strict=True)]
                    score = np.where(lettered, p.max(axis=1).clip(0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scratch.lean(run), "doc_id long, lang_pred string, score double")
