"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word n-grams.  For sets a, b with
Jaccard similarity of at least num/den, the symmetric difference is at most
``(|a| + |b|) * (den - num) / (den + num)``.  Sets are banded by size; within a
band (and, for pairs on either side of a band's upper edge, across it) the
feature domain is cut by hash into first-level partitions, each of them into
``n2`` second-level ones, and every choice of ``n2 - k2`` second-level partitions
of a first-level one gives a signature: the hash of all features in them.
Of n first-level partitions, two sets that differ in at most d features have
``n - d // (k2 + 1)`` in which they differ in at most k2 features, and agree there
on one signature at least.

Refinements that keep this exact and make it cheaper:

* A set of size l has partners that differ in at most ``l * (den - num) / num``
  features, so it gives signatures for the first so many partitions only.
* Signatures of empty choices say nothing and would be shared by many sets, so they
  are not given.  Each size has spare partitions for as many empty ones as are to be
  expected.  A set with more than leave ``SHARED`` common signatures sure, whatever
  the size of its partner (:func:`_sizes`), also gives its prefix, the
  ``l - ceil(l * num / den) + 1`` features least in a fixed order.  What both of two
  sets agree to leave empty is empty in both, so if one of them gives no prefix,
  the pair is found by its partitions; and of two prefixes similar sets share a feature.
* Partitions enough that similar sets agree on ``SHARED`` signatures at least (or on
  one of two prefixes); pairs that share fewer are left out.
* Features that many documents hold (counted in all of them) are left out of the domain and
  come last in the order of prefixes.  Sets that differ in at most d features do
  so in any part of the domain, so nothing is lost whatever is left out; what is
  gained is that passages shared by many documents make no signature common.

Sets are identified by 64-bit digests and compared by 40 bits of each feature's hash.

Signatures take more room than the texts, and the more the smaller the portions they are
dealt in.  So they are made in ``PASSES`` passes over all texts, each with the signatures
of one residue, and what a pass has shuffled is deleted before the next but one writes.

Edge cases: a document that is null, empty or without words has n_shingles 0
and links with nothing; one with fewer words than n is a single n-gram.
Repeated rows of a document stay separate rows with the same values; a null doc_id
counts as one more id, which is named only if all its copies are null.  Ties have no
effect.  An empty table gives an empty one.  Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking, scratch, texthash
from .texthash import mix, segment_sums, signed

WIDTH, NUM, DEN, SHARED = 5, 80, 100, 3
N2, K2 = 3, 1  # second-level partitions, and how many of them a signature leaves out
PASSES = 3  # over the texts, each with a part of the signatures
GROUP = 1 << 20  # features counted at once


def _sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, features, offsets) of each chunk of the batch's texts."""
    data, offsets = texthash.as_bytes(batch.column(column))
    for lo, hi in texthash.chunks(offsets):
        words, owner, _, _ = texthash.word_hashes(data, offsets[lo : hi + 1])
        features, per = texthash.shingles(words, owner, hi - lo, width)
        yield lo, hi, features, per


def _digest(features: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Identifies a set."""
    return signed(mix(segment_sums(mix(features ^ np.uint64(0x5851F42D4C957F2D)), per) + np.diff(per).astype(np.uint64)))


def set_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_id): equal sets have equal set_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, features, per in _sets(batch, 1, width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(per)), pa.array(_digest(features, per))],
                    names=["doc_id", "n_shingles", "set_id"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scratch.lean(run), "doc_id long, n_shingles long, set_id long")


def _most_different(a, b, num: int, den: int):
    """The greatest symmetric difference of similar sets of sizes a and b."""
    return (a + b) * (den - num) // (den + num)


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last], both included, for each pair of places."""
    width, out, tables = last - first + 1, np.empty(len(first)), values
    for power in range(int(width.max()).bit_length()):
        here = width >> power == 1
        out[here] = np.minimum(tables[first[here]], tables[last[here] + 1 - (1 << power)])
        tables = np.minimum(tables[: -(1 << power)], tables[1 << power :])
    return out


@lru_cache(maxsize=64)
def _sizes(edge: int, cross: int, num: int, den: int, n2: int, k2: int, shared: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of a band with the upper edge 2**edge, or of pairs across it: (number of first-level
    partitions, least size, and for it and each greater size how many of the partitions it
    uses, and how many of those may be empty so that ``shared`` signatures are sure).

    Sets of sizes l and y use min(n(l), n(y)) partitions in common; without their differences,
    what is left must be ``shared`` and the empty ones.  n never falls as the size grows, so the
    least is at the greatest y, where n(l) counts, or at a smaller one, where n(y) does.
    """
    most = 1 << edge
    low, high = (-(-most * num // den), most * den // num) if cross else (most // 2 + 1, most)
    size = np.arange(low, high + 1)
    d = int(_most_different(*((most, high) if cross else (most, most)), num, den))
    need = d // (k2 + 1) + 1
    n1 = need + need // 8 + shared + 5
    own = np.minimum(size * (den - num) // num, d) // (k2 + 1) + 1
    # how many partitions are likely to have an empty choice
    empty = own * np.minimum(1.0, comb(n2, k2) * np.exp(-size / n1 * (n2 - k2) / n2))
    n = np.maximum.accumulate(np.minimum(n1, own + shared + 1 + np.ceil(empty + 2.5 * np.sqrt(empty)).astype(np.int64)))
    least, greatest = np.maximum(-(-size * num // den), low), np.minimum(size * den // num, high)
    each = (den - num) / (den + num) / (k2 + 1)
    smaller = size
    if cross:
        greatest, smaller = np.where(size <= most, greatest, most), np.where(size <= most, low, most)
    above = n - _most_different(size, greatest, num, den) // (k2 + 1)
    below = _least_between(n - each * size, np.minimum(least, smaller) - low, smaller - low) - each * size
    if cross:
        below[size <= most] = above[size <= most]  # their partners are greater
    return n1, low, n, np.floor(np.minimum(above, below)).astype(np.int64) - shared


def _cells(features: np.ndarray, n1: int, n2: int) -> tuple[np.ndarray, np.ndarray]:
    """The first-level and second-level partition of each feature."""
    mixed = mix(features + np.uint64(0x632BE59BD9B4E019))
    first = ((mixed >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)).astype(np.int64)
    return first, ((mixed & np.uint64(0xFFFFFFFF)) * np.uint64(n2) >> np.uint64(32)).astype(np.int64)


def signatures(
    features: np.ndarray, per: np.ndarray, ids: np.ndarray, num: int = NUM, den: int = DEN, n2: int = N2, k2: int = K2, common: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures (sig, id) of the sets in ``features``, cut by ``per``; those of prefixes are odd."""
    sizes = np.diff(per)
    keep_sig, keep_id = [np.zeros(0, np.uint64)], [ids[:0]]
    usual = np.zeros(len(features), bool)
    if common is not None and len(common) and len(features):
        place = np.searchsorted(common, features)
        place[place == len(common)] = 0
        usual = common[place] == features
    level = 1_000_003 * n2 + k2
    owner = np.repeat(np.arange(len(sizes)), sizes)
    band = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)  # upper edge 2**band
    # an edge that a pair may straddle: a <= edge < b <= a * den / num
    upper = np.where(sizes * den >= (1 << band) * num, band, -1)
    lower = np.where(sizes * num <= (1 << np.maximum(band - 1, 0)) * den, band - 1, -1)
    for cross, edges in ((0, band), (1, upper), (1, lower)):
        for edge in np.unique(edges[(edges >= 0) & (sizes > 0)]).tolist():
            chosen = (edges == edge) & (sizes > 0)
            which = np.flatnonzero(chosen)
            n1, low, parts, room = _sizes(edge, cross, num, den, n2, k2, SHARED)
            parts, room = parts[sizes[which] - low], room[sizes[which] - low]
            local = np.full(len(sizes), -1, np.int64)
            local[which] = np.arange(len(which))
            rows = chosen[owner] & ~usual
            f, own = features[rows], local[owner[rows]]
            cell, sub = _cells(f, n1, n2)
            used = cell < parts[own]
            flat = (own[used] * n1 + cell[used]) * n2 + sub[used]
            sums = np.zeros(len(which) * n1 * n2, np.uint64)
            np.add.at(sums, flat, mix(f[used] ^ np.uint64(0x2545F4914F6CDD1D)))
            counts = np.bincount(flat, minlength=len(sums)).reshape(-1, n2)
            sums = sums.reshape(-1, n2)
            doc, part = np.repeat(np.arange(len(which)), n1), np.tile(np.arange(n1), len(which))
            live = part < parts[doc]
            empty = np.zeros(len(doc), bool)
            for subset in combinations(range(n2), n2 - k2):
                total = sums[:, list(subset)].sum(axis=1, dtype=np.uint64)
                filled = counts[:, list(subset)].sum(axis=1) > 0
                empty |= live & ~filled
                give = live & filled
                salt = np.uint64(((edge * 2 + cross) * 7919 + level * 104729 + sum(1 << (s + 40) for s in subset)) & (2**64 - 1))
                keep_sig.append(mix(total[give] ^ mix(part[give].astype(np.uint64) + salt)) & ~np.uint64(1))
                keep_id.append(ids[which[doc[give]]])
            for k in np.flatnonzero(np.bincount(doc[empty], minlength=len(which)) > room):
                mine = slice(per[which[k]], per[which[k] + 1])
                n = sizes[which[k]]
                prefix = features[mine][np.argsort(usual[mine], kind="stable")][: n - (n * num + den - 1) // den + 1]
                keep_sig.append(mix(prefix ^ np.uint64(0xA0761D6478BD642F + edge * 2 + cross)) | np.uint64(1))
                keep_id.append(np.full(len(prefix), ids[which[k]]))
    return signed(np.concatenate(keep_sig)), np.concatenate(keep_id)


def _signature_rows(docs: DataFrame, width: int, num: int, den: int, n2: int, k2: int, common: np.ndarray, nth: int = 0, passes: int = 1) -> DataFrame:
    """(sig, id) of the signatures that the pass ``nth`` of ``passes`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, features, per in _sets(batch, 0, width):
                sig, ids = signatures(features, per, _digest(features, per), num, den, n2, k2, common)
                mine = (sig.view(np.uint64) >> np.uint64(1)) % np.uint64(passes) == nth
                yield pa.RecordBatch.from_arrays([pa.array(sig[mine]), pa.array(ids[mine])], names=["sig", "id"])

    return docs.select("text").mapInArrow(scratch.lean(run), "sig long, id long")


def common_features(docs: DataFrame, count: int, width: int, share: float = 0.004) -> np.ndarray:
    """Features of about ``share`` of all ``count`` documents or more, ascending; they only make the join faster.

    All documents are counted, in one pass of lossy counting: a task counts the features of
    ``GROUP`` to twice as many at once, and leaves out those that fewer than share / 4 of
    the group's documents hold, or only one.  A feature that is not left out anywhere has its exact count.  At
    most 4 / (3 * share) of the mean set size are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting = [], []  # features, documents

        def counted(parts: list) -> pa.RecordBatch:
            f, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in parts)]), return_counts=True)
            often = n >= max(2, share / 4 * sum(d for _, d in parts))
            return pa.RecordBatch.from_arrays([pa.array(signed(f[often])), pa.array(n[often])], names=["f", "n"])

        for batch in batches:
            for lo, hi, features, _ in _sets(batch, 0, width):
                group.append((features, hi - lo))
                if sum(len(f) for f, _ in group) >= GROUP:
                    if waiting:
                        yield counted(waiting)
                    group, waiting = [], group
        yield counted(waiting + group)

    # tasks of many documents, as each leaves out what is rare in it
    some = docs.select("text").coalesce(max(1, count // 8_192))
    counts = some.mapInArrow(scratch.lean(run), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, 0.75 * share * count))
    return np.sort(np.array([r["f"] for r in counts.select("f").collect()], np.int64).view(np.uint64))


def _packed(features: np.ndarray) -> bytes:
    """The upper 40 bits of each hash, in five bytes."""
    top = features >> np.uint64(24)
    return (top >> np.uint64(8)).astype(np.uint32).tobytes() + top.astype(np.uint8).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    n = len(packed) // 5
    return np.frombuffer(packed, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(packed, np.uint8, n, 4 * n)


def verifier(num: int, den: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Keeps the pairs (x, y) with den * |x & y| >= num * |x | y|."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, fx, fy = (batch.column(i).to_pylist() for i in range(4))
            keep, last, a = [], None, None
            for i in range(len(x)):
                if x[i] != last:
                    last, a = x[i], _unpacked(fx[i])
                b = _unpacked(fy[i])
                lo, hi = (a, b) if len(a) < len(b) else (b, a)
                at = np.searchsorted(hi, lo)
                at[at == len(hi)] = 0
                both = int(np.count_nonzero(hi[at] == lo)) if len(hi) else 0
                if both and den * both >= num * (len(a) + len(b) - both):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["x", "y"])

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        fx = sets.select(F.col("id").alias("x"), F.col("features").alias("fx"))
        fy = sets.select(F.col("id").alias("y"), F.col("features").alias("fy"))
        return pairs.join(fy, "y").join(fx, "x").select("x", "y", "fx", "fy").mapInArrow(scratch.lean(check), "x long, y long")

    return verify


def jaccard_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, small: int = 16, n2: int = N2, k2: int = K2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    component_id: the least doc_id reachable over links of Jaccard similarity
    num/den or more.  Documents with equal sets are one member from the start;
    their copies are never compared with each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = scratch.save(set_digests(docs, width), "sets")
    least = classes.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))

    def prepare(ids: DataFrame) -> DataFrame:
        wanted = linking.sized(scratch.save(least.join(ids.withColumnRenamed("id", "set_id"), "set_id").select(F.col("least").alias("doc_id")), "wanted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, features, per in _sets(batch, 0, width):
                    sets = [_packed(features[per[i] : per[i + 1]]) for i in range(len(per) - 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(_digest(features, per)), pa.array(sets, pa.binary())], names=["id", "features"])

        return docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(scratch.lean(run), "id long, features binary")

    def as_sets(a: list, b: list) -> tuple[list, list]:
        return [_unpacked(x) for x in a], [_unpacked(x) for x in b]

    common = common_features(docs, classes.count(), width)
    sigs = (_signature_rows(docs, width, num, den, n2, k2, common, nth, PASSES) for nth in range(PASSES))
    comp = linking.link(sigs, prepare, verifier(num, den), as_sets, num, den, small, SHARED)
    if comp is None:
        comp = docs.sparkSession.createDataFrame([], "id long, comp long")
    named = comp.join(least, F.col("id") == F.col("set_id")).groupBy("comp").agg(F.min("least").alias("first"))
    of_set = least.join(comp, F.col("id") == F.col("set_id"), "left").join(named, "comp", "left").select("set_id", F.coalesce("first", "least").alias("component_id"))
    return classes.join(of_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
