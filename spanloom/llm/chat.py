"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>[INST] role [/INST]``, newline, content, ``</s>``, newline; only the
content of assistant turns is under the loss mask.  Where a
role or content holds one of the template's control strings, or something that
would read as an escaped one, a backslash goes behind its first character; taking
one away again is exact.

For each Arrow batch the lengths of all segments, their cumulative offsets and the
scatter indices are computed in numpy, and headers and contents are copied into
one preallocated buffer, which becomes the output column as it is.  Conversations
are streamed in order of turn, so one that holds a third of all rows needs no
more memory than another; its text comes in several parts, numbered by seq.

Edge cases: null text, role and turn read as an empty text, an empty role and
first in order; repeated turns stay, ordered by turn, role and text; a null
conv_id is a conversation of its own; an empty table gives an empty one.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .texthash import as_bytes

OPEN, MIDDLE, CLOSE = b"<s>[INST] ", b" [/INST]\n", b"</s>\n"
LONG = 1 << 16
_ESCAPE = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
_PLAIN = re.compile(r"([<\[])\\(\\*)(?=s>|/s>|INST\]|/INST\])")
_PARTS = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.S)


def escape(column: pa.Array) -> pa.Array:
    column = column.cast(pa.large_string())
    return pc.replace_substring_regex(pc.fill_null(column, ""), _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1\2", text)


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Scatters the segments of ``data`` to the places ``at`` of ``out``; long ones are copied whole."""
    sizes = np.diff(offsets)
    for k in np.flatnonzero(sizes > LONG):
        out[at[k] : at[k] + sizes[k]] = data[offsets[k] : offsets[k + 1]]
    if (sizes > LONG).any():
        short = np.flatnonzero(sizes <= LONG)
        data = np.concatenate([data[:0], *(data[offsets[k] : offsets[k + 1]] for k in short)])
        at, sizes = at[short], sizes[short]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    base = int(offsets[0])
    index = np.arange(int(offsets[-1]) - base) + np.repeat(at - (offsets[:-1] - base), sizes)
    out[index] = data[base : int(offsets[-1])]


def _constant(out: np.ndarray, at: np.ndarray, text: bytes) -> None:
    out[at[:, None] + np.arange(len(text))] = np.frombuffer(text, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns, start and end of each one's loss span in bytes; equal: none)."""
    assistant = np.asarray(pc.fill_null(pc.equal(roles.cast(pa.string()), "assistant"), False))
    role_data, role_at = as_bytes(escape(roles))
    text_data, text_at = as_bytes(escape(texts))
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    total = len(OPEN) + role_size + len(MIDDLE) + text_size + len(CLOSE)
    offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    start = offsets[:-1]
    out = np.empty(int(offsets[-1]), np.uint8)
    _constant(out, start, OPEN)
    _copy(out, start + len(OPEN), role_data, role_at)
    content = start + len(OPEN) + role_size + len(MIDDLE)
    _constant(out, content - len(MIDDLE), MIDDLE)
    _copy(out, content, text_data, text_at)
    _constant(out, content + text_size, CLOSE)
    column = pa.Array.from_buffers(pa.large_string(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    lo = content - start
    return column, lo, np.where(assistant, lo + text_size, lo)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, formatted, loss_start, loss_end): the formatted text of a conversation is
    its parts in order of seq; the loss span of a part is in bytes."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            column, lo, hi = assemble(batch.column(1), batch.column(2))
            ids = batch.column(0)
            key, null = np.asarray(pc.fill_null(ids, 0)), np.asarray(ids.is_null())
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
            if len(key):
                new[0] = last != (key[0], null[0])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            seq = np.arange(len(key)) - begin
            seq = np.where(begin < 0, np.arange(len(key)) + count, seq)
            if len(key):
                last, count = (key[-1], null[-1]), int(seq[-1]) + 1
            yield pa.RecordBatch.from_arrays([ids, pa.array(seq.astype(np.int64)), column.cast(pa.string()), pa.array(lo), pa.array(hi)], names=["conv_id", "seq", "formatted", "loss_start", "loss_end"])

    return ordered.select("conv_id", "role", "text").mapInArrow(scratch.lean(run), "conv_id long, seq long, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted parts alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.  The parts may come in any order, as from a
    stored table; digests grow part by part."""
    parts = formatted.select("conv_id", "seq", "formatted", "loss_start", "loss_end")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = None, None

        def row() -> dict:
            turns, digest, loss_chars, loss, chars = state
            return {"conv_id": open_id, "n_turns": turns, "turns_sha256": digest.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

        for batch in batches:
            done = []
            ids, _, texts, starts, ends = (batch.column(i).to_pylist() for i in range(5))
            for conv, text, start, end in zip(ids, texts, starts, ends, strict=True):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append(row())
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _PARTS.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if end > start:
                    masked = unescape(text.encode()[start:end].decode())
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=_DIGESTS)

    return ordered.mapInArrow(scratch.lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
