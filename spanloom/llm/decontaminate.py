"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with white space as single
blanks.  An item may occur with up to e = ``rate`` of its length in edit errors.
It is split into e + 1 pieces; wherever it occurs, one piece at least occurs
exactly.  All pieces are searched at once by an Aho-Corasick automaton, and around
each hit the item is verified by Myers' bit-parallel edit distance.

Documents are read once, without any shuffle.  The items are a small table: they
are sent to the tasks in portions of at most ``MAX_CHARS`` characters, each with a
pass of its own, so that a large benchmark costs time and not memory.

Edge cases: null or empty texts and items match nothing; equal items are all
reported; rows that repeat a doc_id are reported each.  An item is searched whatever its
length: one of a character or two is found in nearly every text, so leave such items out of
the table if that is not meant.  Of several occurrences with the least distance the first is
reported.  An empty table of documents gives an empty one, without items nothing is found; other
columns of either table come through or are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

RATE, MAX_CHARS = 0.05, 2_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def split_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any substring of ``text``, its first end)."""
    m = len(pattern)
    masks = pattern_masks(pattern) if masks is None else masks
    top, full = 1 << (m - 1), (1 << m) - 1
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(xv | plus) & full
        down = plus & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


@dataclass
class Matcher:
    """Finds items in normalised texts."""

    items: list[tuple[int, str]]
    rate: float = RATE

    def __post_init__(self):
        self.errors = [int(len(t) * self.rate) for _, t in self.items]
        self.masks = [pattern_masks(t) for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for offset, piece in split_pieces(text, self.errors[k]):
                if piece:
                    pieces.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item number -> (least distance, end of its first such occurrence)."""
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[int]] = {}
        if not self.any or not text:
            return found
        for stop, (size, uses) in self.automaton.iter(text):
            for k, offset in uses:
                e, item = self.errors[k], self.items[k][1]
                start = stop + 1 - size - offset
                if found.get(k, (1,))[0] == 0 or any(abs(start - s) <= e for s in tried.get(k, ())[-8:]):
                    continue  # exact already, or inside a window that has been verified
                lo, hi = max(0, start - 2 * e), start + len(item) + 2 * e
                tried.setdefault(k, []).append(start)
                if text.startswith(item, max(0, start)):
                    found[k] = (0, max(0, start) + len(item))
                    continue
                distance, end = myers(item, text[lo:hi], self.masks[k])
                if distance <= e and distance < found.get(k, (e + 1,))[0]:
                    found[k] = (distance, lo + end)
        return found


def portions(benchmark: DataFrame, most: int = MAX_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, normalised text), in portions of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text") + F.lit(16))).first()[0] or 0
    parts = max(1, -(-int(total) * 2 // most)) if total > most else 1
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted({(r["item_id"], t) for r in some.collect() if (t := normal(r["text"]))})


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = MAX_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): items that occur in documents, with the least
    edit distance and the end of that occurrence in the normalised text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in portions(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                at, item, distance, end = [], [], [], []
                for i in range(len(batch)):
                    for k, (d, stop) in sorted(matcher.find(normal(batch.column(1)[i].as_py())).items()):
                        at.append(i), item.append(matcher.items[k][0]), distance.append(d), end.append(stop)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "end"])

        part = rows.mapInArrow(scratch.lean(run), "doc_id long, item_id long, distance int, end long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = MAX_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs."""
    place, schema = docs.columns.index("text"), docs.schema
    for items in portions(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                keep = np.array([not matcher.find(normal(t.as_py())) for t in batch.column(place)], bool)
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scratch.lean(run), schema)
    return docs
