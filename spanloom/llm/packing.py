"""Best-fit packing of token sequences, bulk-synchronously.

Texts are tokenised (a public vocabulary file, its path a parameter) and end with
a separator id.  Only documents longer than the sequence length are cut.

Packing is best-fit with the longest pieces first, in supersteps.  Pieces are
ranked within their length, and open sequences are kept sorted by gap; both are
described by runs of equals (a length with its number of pieces; a gap with a
range of sequence numbers), so a superstep handles all pieces of a length at once
wherever they are stored.  A superstep sweeps for the successor of its length
among the gaps, the least gap that is large enough; the pieces compete for it and
their rank decides who gets which sequence of the run; the run's gaps are
updated and re-sorted; and the sweep repeats until no piece of the length is
left, opening sequences when no gap is large enough.  The outcome is that of
sequential best-fit.  The plan has runs of lengths only (at most ``length``
lengths, two more runs for each sweep), never rows; the pieces themselves stay
distributed and are placed by their rank without another shuffle.

Edge cases: null text is empty, an empty document is the separator alone; rows
that repeat a doc_id are packed as separate documents.  Pieces of equal length are ranked by
task and place in it, gaps of equal size by sequence number.  An empty table gives an empty
one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

LENGTH, END, CACHE = 2048, 0, 300_000
_BEHIND = re.compile(rb"(?<=[a-z0-9])([.,!?;:%$#&*|]+)(?=[\x20\x09-\x0d]|\Z)")


#: The steps of a vocabulary that is blind to case and joins nothing across white space.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordTokenizer:
    """Ids of texts by a vocabulary file.

    If the file names the steps above, words are encoded once and remembered, up to
    ``cache`` of them; a full memory keeps the words in use.  Plain punctuation at a word's end,
    behind a letter or digit, is a word of its own, as the vocabulary never joins it either.  Words of letters alone are encoded many at a time: each
    gives one piece that ends in an id whose token has the suffix of a word's end.
    With any other file, whole texts are encoded as they are.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.cache = Tokenizer.from_file(path), {}, cache
        steps = json.loads(self.tokenizer.to_str())
        split = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (steps.get("normalizer") or {}).get("normalizers") == _NORMALIZER and not steps["post_processor"] and len(split) == 2
        self.by_word = self.by_word and split[0].get("pattern") == {"Regex": _WORDS} and split[1].get("add_prefix_space") is False
        suffix, vocabulary = steps["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    def _one_by_one(self, words: list[bytes]) -> None:
        for word, code in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[word] = np.array(code.ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        letters, others = [], []
        for word in words:
            (letters if word.isalpha() or word.decode().isalpha() else others).append(word)
        for lo in range(0, len(letters), 5_000):
            part = letters[lo : lo + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):  # a letter whose lower case is more than a letter
                self._one_by_one(part)
                continue
            data = ids.tobytes()
            self.known.update((word, data[a:b]) for word, a, b in zip(part, [0, *ends], ends))  # noqa: B905  the last end starts nothing
        for lo in range(0, len(others), 5_000):
            self._one_by_one(others[lo : lo + 5_000])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text, without special tokens."""
        if not self.by_word:
            return [np.array(code.ids, "<u4").tobytes() for code in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        split = [_BEHIND.sub(rb" \1", t.lower()).split() for t in texts]  # A-Z only; at 0x20, 0x09-0x0d
        words = set().union(*split)
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.cache:
            self.known = {w: self.known[w] for w in words - new}
        self._learn(list(new))
        known = self.known
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker, which serves many tasks."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): part and nth, the task and the
    piece's number among those of its length there, make its rank."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = 512
            for lo in range(0, len(batch), rows):
                coded = tokenizer.encode([t.as_py() or b"" for t in texts.slice(lo, rows)])
                at, piece, start, size, crc = [], [], [], [], []
                for i, ids in enumerate(coded):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[s : s + 4 * length]
                        at.append(lo + i), piece.append(k), start.append(s // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
                sizes = np.array(size, np.int64)
                order = np.argsort(sizes, kind="stable")
                ordered = sizes[order]
                first = np.searchsorted(ordered, ordered)
                nth = np.empty(len(sizes), np.int64)
                nth[order] = np.arange(len(sizes)) - first + seen[ordered]
                seen += np.bincount(sizes, minlength=length + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scratch.lean(run), schema).withColumn("part", F.spark_partition_id())


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit by runs: (length, first rank, first sequence, pieces for each sequence, offset).

    ``counts``: pieces by length.  A run's pieces take consecutive sequences.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, (size, -1, -1))  # the successor
            if at == len(gaps):
                each = capacity // size
                many = -(-left // each)
                insort(gaps, (capacity, opened, many))
                opened += many
                continue
            gap, first, many = gaps.pop(at)
            each = gap // size
            full = min(many, left // each)
            if full:
                placed.append((size, rank, first, each, capacity - gap))
                rank, left = rank + full * each, left - full * each
                if gap - each * size:
                    insort(gaps, (gap - each * size, first, full))
            if full < many and left:  # fewer than fill one more sequence
                placed.append((size, rank, first + full, each, capacity - gap))
                if gap - left * size:
                    insort(gaps, (gap - left * size, first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                insort(gaps, (gap, first + full, many - full))
    return placed


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    rows = scratch.save(pieces(docs, path, length), "pieces")
    tallies = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    tallies = tallies.withColumn("base", F.coalesce(before, F.lit(0))).select("length", "part", "base")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    runs = np.array(plan(counts, length), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # length * 2**44 + rank, so that one search finds a piece's run
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]
    shared = spark.sparkContext.broadcast((keys, runs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = shared.value
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            run = runs[np.searchsorted(keys, size * (1 << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = rows.join(tallies, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(scratch.lean(place), schema)
