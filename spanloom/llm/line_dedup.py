"""Fuzzy line deduplication by MinHash.

A line is what stands between newlines, without white space at its ends and
with A-Z read as a-z; blank lines are not compared and always stay.  Equal
lines are one member from the start.  Each distinct line gives a one-permutation
MinHash of its character shingles (``BANDS * ROWS`` bins, empty bins filled by
rotation), banded for recall: two lines of Jaccard similarity 0.8 share a band
with probability 1 - (1 - 0.8**5)**12 = 0.992, of 0.85 with 0.9993.  Pairs are
verified by exact Jaccard similarity of their shingle sets, linked by
distributed union-find, and of each component only the line that comes first
(least doc_id, then line number) stays.

Edge cases: null or empty text has no lines and stays as it is.  Rows that
repeat a doc_id count as the same document: their n-th lines stay or go together.  Ties
between lines are settled by doc_id (null last) and line number.  An empty table gives an
empty one; other columns come through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking, scratch, texthash
from .texthash import SPACE, mix, signed

SHINGLE, BANDS, ROWS, NUM, DEN = 8, 12, 5, 80, 100
OWNER = np.uint64(44)
PIECE, MEMORY = 1 << 17, 1 << 18  # bytes handled at once, so that temporaries stay in the caches; lines remembered


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, line number, start, end) of the lines that are not blank, trimmed."""
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    bounds = offsets - base
    breaks = np.flatnonzero(part == 10)
    starts = np.concatenate([bounds[:-1], breaks + 1])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    owner = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1])[order]
    first = np.searchsorted(owner, np.arange(len(bounds) - 1))
    number = np.arange(len(owner)) - first[owner]
    ends = np.append(starts[1:], len(part))
    last_of_doc = np.append(owner[1:] != owner[:-1], True)
    ends[last_of_doc] = bounds[owner[last_of_doc] + 1]
    ends[~last_of_doc] -= 1
    solid = np.flatnonzero(~SPACE[part])
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = lo < hi
    return owner[some], number[some], solid[lo[some]], solid[hi[some] - 1] + 1


def _prefix(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = texthash._powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(texthash._FOLDED[part] * power[:-1], out=sums[1:])
    return sums, inverse


def grams_of(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the character shingles of lines in ascending order; a shorter line is one shingle."""
    sums, inverse = _prefix(part)
    chars = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
    lo, hi = np.searchsorted(chars, starts), np.searchsorted(chars, ends)
    count = np.maximum(hi - lo - size + 1, 0)
    line = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(line)) + np.repeat(lo - (np.cumsum(count) - count), count)
    begin = chars[at]
    grams = mix((sums[chars[at + size]] - sums[begin]) * inverse[begin])
    short = np.flatnonzero(hi - lo < size)
    if len(short):
        grams = np.concatenate([grams, mix((sums[ends[short]] - sums[starts[short]]) * inverse[starts[short]])])
        line = np.concatenate([line, short])
    return grams, line


def shingle_keys(lines: pa.Array, size: int) -> np.ndarray:
    """Ascending distinct keys of the shingles of up to 2**20 lines: the line's number above 44 bits of hash."""
    lines = lines.cast(pa.large_binary())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    part = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    grams, line = grams_of(part, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], size)
    keys = np.sort(line.astype(np.uint64) << OWNER | grams >> np.uint64(20))
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def minhashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, bins: int) -> np.ndarray:
    """One-permutation MinHash (lines x bins) of the character shingles of lines in ascending order."""
    grams, line = grams_of(part, starts, ends, size)
    slot = (grams >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    value = grams & np.uint64(0xFFFFFFFF)
    none = np.uint64(1 << 40)
    table = np.full(len(starts) * bins, none)
    np.minimum.at(table, line * bins + slot.astype(np.int64), value)
    table = table.reshape(-1, bins)
    gaps = np.flatnonzero((table == none).any(axis=1))
    if len(gaps):
        twice = np.concatenate([table[gaps]] * 2, axis=1)
        place = np.where(twice != none, np.arange(2 * bins), 4 * bins)
        place = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :bins]
        far = (place - np.arange(bins)).astype(np.uint64)
        table[gaps] = np.take_along_axis(twice, place, axis=1) + far * np.uint64(0x100000001)
    return table


def _line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line, line_id) of every line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texthash.as_bytes(batch.column(1))
            for lo, hi in texthash.chunks(offsets):
                part = data[int(offsets[lo]) : int(offsets[hi])]
                owner, number, starts, ends = split_lines(data, offsets[lo : hi + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + lo)), pa.array(number.astype(np.int32)), pa.array(signed(texthash.span_hashes(part, starts, ends)))], names=["doc_id", "line", "line_id"]
                )

    return docs.select("doc_id", "text").mapInArrow(scratch.lean(run), "doc_id long, line int, line_id long")


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ids, starts, ends) of the distinct lines of pieces of ``PIECE`` bytes or one line.

    A table of fixed size remembers lines of the same task, so that most repeats are left out;
    the others do no harm.
    """
    known = np.zeros(MEMORY, np.uint64)
    known[0] = 1  # not a hash of that slot
    for batch in batches:
        data, offsets = texthash.as_bytes(batch.column(0))
        for lo, hi in texthash.chunks(offsets):
            part = data[int(offsets[lo]) : int(offsets[hi])]
            _, _, starts, ends = split_lines(data, offsets[lo : hi + 1])
            spans = texthash.span_hashes(part, starts, ends)
            _, at = np.unique(spans, return_index=True)
            at = np.sort(at)
            slot = (spans[at] % np.uint64(MEMORY)).astype(np.int64)
            fresh = known[slot] != spans[at]
            known[slot] = spans[at]
            at = at[fresh]
            ids, starts, ends = spans[at], starts[at], ends[at]
            cuts = np.flatnonzero(np.diff(starts // PIECE)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
                if a < b:
                    first = starts[a]
                    yield part[first : ends[b - 1]], ids[a:b], starts[a:b] - first, ends[a:b] - first


def _bands(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = texthash._MULTS[:rows]
        for part, ids, starts, ends in _distinct_lines(batches):
            table = minhashes(part, starts, ends, size, bands * rows).reshape(len(ids), bands, rows)
            sig = mix((mix(table) * odd).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig.ravel())), pa.array(signed(np.repeat(ids, bands)))], names=["sig", "id"])

    return docs.select("text").mapInArrow(scratch.lean(run), "sig long, id long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, bytes) of the lines in ``ids``, a saved table, and of a few others if those are many;
    a line may come from several tasks."""
    chosen = linking.Among(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, starts, ends in _distinct_lines(batches):
            here = chosen(signed(ids))
            ids, starts, ends = ids[here], starts[here], ends[here]
            if not len(ids):
                continue
            edges = np.zeros(len(part) + 1, np.int8)
            edges[starts] += 1
            edges[ends] -= 1
            inside = part[np.cumsum(edges[:-1], dtype=np.int8) > 0]
            offsets = np.concatenate([[0], np.cumsum(ends - starts)])
            lines = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(inside.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), lines.cast(pa.binary())], names=["id", "bytes"])

    return docs.select("text").mapInArrow(scratch.lean(run), "id long, bytes binary")


def shingle_set(line: bytes, size: int) -> set[str]:
    text = line.lower().decode("utf-8", "replace")
    return {text[i : i + size] for i in range(max(1, len(text) - size + 1))}


def _verifier(size: int, num: int, den: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_x, bytes_y = (pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            piece = np.cumsum(bytes_x + bytes_y) // PIECE
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
                if lo == hi:
                    continue
                a, b = (shingle_keys(batch.column(c).slice(lo, hi - lo), size) for c in (2, 3))
                every = np.sort(np.concatenate([a, b]))
                both, of_a, of_b = (np.bincount((k >> OWNER).astype(np.int64), minlength=hi - lo) for k in (every[1:][every[1:] == every[:-1]], a, b))
                keep = pa.array(lo + np.flatnonzero(den * both >= num * (of_a + of_b - both)))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["x", "y"])

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        bx = texts.select(F.col("id").alias("x"), F.col("bytes").alias("bx"))
        by = texts.select(F.col("id").alias("y"), F.col("bytes").alias("by"))
        return pairs.join(by, "y").join(bx, "x").select("x", "y", "bx", "by").mapInArrow(scratch.lean(check), "x long, y long")

    return verify


def line_components(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, line, line_id, keep) of every line that is not blank.

    keep: whether it is the first line of its component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.save(_line_table(docs), "lines")

    def prepare(ids: DataFrame) -> DataFrame:
        return _texts(docs, scratch.save(ids, "ids")).groupBy("id").agg(F.min("bytes").alias("bytes"))

    def as_sets(a: list, b: list) -> tuple[list, list]:
        def sets(rows: list) -> list:
            piece, out = np.cumsum([len(r) for r in rows]) // PIECE, []
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(rows)), strict=True):
                keys = shingle_keys(pa.array(rows[lo:hi], pa.binary()), size)
                out += np.split(keys & np.uint64((1 << 44) - 1), np.searchsorted(keys >> OWNER, np.arange(1, hi - lo).astype(np.uint64)))
            return out

        return sets(a), sets(b)

    comp = linking.link([_bands(docs, size, bands, rows)], prepare, _verifier(size, num, den), as_sets, num, den)
    firsts = lines.groupBy("line_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")).alias("first"))
    if comp is not None:
        firsts = scratch.save(firsts, "own")
        named = comp.withColumnRenamed("id", "line_id")
        # distinct lines only: a component's first line over its members, then back to them
        of_comp = firsts.join(named, "line_id").groupBy("comp").agg(F.min("first").alias("least"))
        linked = named.join(of_comp, "comp").select("line_id", "least")
        firsts = firsts.join(linked, "line_id", "left").select("line_id", F.coalesce("least", "first").alias("first"))
    # written first, so that both sides are plain and Spark can split the rows of a very common line
    found = lines.join(scratch.save(firsts, "firsts"), "line_id")
    return found.select("doc_id", "line", "line_id", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line") == F.col("first.line"))).alias("keep"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) for each document: counts of lines that
    are not blank, and the numbers (from 0, all lines counted) of those that go."""
    marked = line_components(docs, **options)
    per = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.when(F.col("keep"), 0).otherwise(1)).alias("n_dropped"),
        F.sort_array(F.collect_list(F.when(~F.col("keep"), F.col("line")))).alias("dropped"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(per.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_dropped", zero).alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines cut from text; a document that loses all its lines goes.

    Documents that lose nothing keep their text byte for byte; n_chars, where
    it is a column, follows the text.
    """
    gone = line_components(docs, **options).where(~F.col("keep")).groupBy("doc_id").agg(F.collect_list("line").alias("__gone"))
    # only texts that change are dealt out with the numbers of their lines
    joined = docs.join(gone.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("__gone", i))
    blank = F.forall(kept, lambda line: F.length(F.regexp_replace(line, "[ \\t-\\r]", "")) == 0)
    out = joined.withColumn("__goes", F.when(F.col("__gone").isNull(), False).otherwise(blank)).where(~F.col("__goes"))
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
