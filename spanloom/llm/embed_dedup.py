"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of one label are scaled to length 1 and rotated onto the principal axes
of the whole table (64 x 64 sums, gathered exactly).  cos >= c then means a
distance of at most eps = sqrt(2 - 2c), in the full space and in any leading
dimensions.  Vectors are sorted by label and by the grid cells (side eps) of
their leading principal dimensions and cut into sequence intervals, the
blocks.  Pairs of blocks whose bounding boxes are further apart than eps are
skipped; the others are joined recursively, halving the longer interval and
skipping again, down to small leaves that are compared by one matrix product.

Equal vectors of a label are one member with a multiplicity, so a third of all
rows being one vector costs nothing.  A block pair returns, for each vector,
its number of links and its component within the pair: never the pairs.

Rows that repeat a vec_id stay separate vectors, with their own links; their ids tie as one
number, so each of them is kept if that number is its component's least.  An empty table gives an
empty one.  Other columns are not read, whatever their names.

Edge cases: a null vec_id, a null label or a vector that is null, zero, or holds null or
non-finite components links with nothing (n_links 0, component itself).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking, scratch

LEAD, BLOCK, LEAF = 6, 2048, 256


def unit(vectors: np.ndarray) -> np.ndarray:
    big = np.max(np.abs(vectors), axis=1, keepdims=True)
    vectors = vectors / big
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _rows(binary) -> np.ndarray:
    return np.frombuffer(b"".join(binary), np.float64).reshape(len(binary), -1)


def _valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector as the bytes of float64) of every row; vector is null where it cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, label, vector in zip(batch.column(0).is_valid(), batch.column(1).is_valid(), batch.column(2), strict=True):
                usable = i.as_py() and label.as_py() and vector.is_valid
                v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) if usable else np.zeros(0)
                out.append((v + 0.0).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return rows.mapInArrow(scratch.lean(run), "vec_id long, label string, vector binary")


def axes(members: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from the second moments of all members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for part in batches:
            for size, group in part.groupby(part["vector"].map(len)):
                v = unit(_rows(list(group["vector"])))
                sums = total.setdefault(size // 8, [0, 0.0, 0.0])
                sums[0] += len(v)
                sums[1] = sums[1] + v.sum(axis=0)
                sums[2] = sums[2] + v.T @ v
        for dim, (n, s, c) in total.items():
            flat = np.concatenate([s, c.ravel()])
            yield pd.DataFrame({"dim": dim, "at": np.arange(-1, len(flat)), "value": np.concatenate([[n], flat])})

    found: dict[int, np.ndarray] = {}
    sums = members.select("vector").mapInPandas(run, "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
    for dim, group in sums.toPandas().groupby("dim"):
        values = group.sort_values("at")["value"].to_numpy()
        n, s, c = values[0], values[1 : 1 + dim] / values[0], values[1 + dim :].reshape(dim, dim)
        _, vectors = np.linalg.eigh(c / n - np.outer(s, s))
        found[int(dim)] = np.ascontiguousarray(vectors[:, ::-1])
    return found


def near(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return a @ b.T >= cosine


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, eps: float) -> bool:
    """Whether two boxes are provably further apart than eps."""
    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) > eps * eps * (1 + 1e-9) + 1e-12


def interval_join(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, eps: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions (i, j) of two sequence intervals, leaf by leaf."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        x, y = lead_a[i:m], lead_b[j:n]
        if apart(x.min(0), x.max(0), y.min(0), y.max(0), eps):
            continue
        if m - i <= LEAF and n - j <= LEAF:
            p, q = np.nonzero(near(a[i:m], b[j:n], cosine))
            if len(p):
                yield p + i, q + j
        elif m - i >= n - j:
            half = (i + m) // 2
            stack += [(i, half, j, n), (half, m, j, n)]
        else:
            half = (j + n) // 2
            stack += [(i, m, j, half), (i, m, half, n)]


def embedding_components(embeddings: DataFrame, cosine: float = 0.98, lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings``."""
    spark = embeddings.sparkSession
    eps = math.sqrt(2 - 2 * cosine)
    valid = scratch.save(_valid(embeddings), "vectors")
    classes = valid.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # as vec_ids may repeat
    rotate = axes(classes)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for size, group in part.groupby(part["vector"].map(len)):
                vectors = unit(_rows(list(group["vector"])))
                front = vectors @ rotate[size // 8][:, :lead]
                cells = np.floor(front / eps).astype(np.int64)
                order = [sum((int(c) + (1 << 9)) << (10 * (5 - k)) for k, c in enumerate(row[:6])) for row in cells]
                yield pd.DataFrame({"label": group["label"].astype(str) + f"/{size // 8}", "cell": order, "id": group["id"], "copies": group["copies"], "vector": [v.tobytes() for v in vectors]})

    schema = "label string, cell long, id long, copies long, vector binary"
    ordered = classes.mapInPandas(project, schema).repartitionByRange("label", "cell", "id").sortWithinPartitions("label", "cell", "id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sequence intervals of one label: at most ``block`` vectors each."""

        def one(part: pd.DataFrame) -> dict:
            vectors = _rows(list(part["vector"]))
            front = vectors @ rotate[vectors.shape[1]][:, :lead]
            return {"label": part["label"].iloc[0], "block": int(part["id"].iloc[0]), "lo": front.min(0).tolist(), "hi": front.max(0).tolist(), "ids": part["id"].to_numpy(np.int64).tobytes(), "copies": part["copies"].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes()}

        rest = None
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            done = []
            runs = np.flatnonzero(np.append(True, part["label"].to_numpy()[1:] != part["label"].to_numpy()[:-1])).tolist() + [len(part)]
            for k in range(len(runs) - 1):
                at = runs[k]
                while runs[k + 1] - at >= block or (k < len(runs) - 2 and at < runs[k + 1]):
                    stop = min(at + block, runs[k + 1])
                    done.append(one(part.iloc[at:stop]))
                    at = stop
            rest = part.iloc[at:]
            if done:
                yield pd.DataFrame(done)
        if rest is not None and len(rest):
            yield pd.DataFrame([one(rest)])

    blocks = scratch.save(ordered.mapInPandas(cut, "label string, block long, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary"), "blocks")
    boxes = blocks.select("label", "block", "lo", "hi")

    # blocks meet in the eps-wide strips of the first two principal dimensions that both touch
    strips = boxes
    for k in range(min(lead, 2)):
        here = F.sequence(F.floor(F.get("lo", F.lit(k)) / eps), F.floor(F.get("hi", F.lit(k)) / eps) + 1)
        strips = strips.withColumn(f"strip{k}", F.explode(F.coalesce(here, F.array(F.lit(0).cast("long")))))
    keys = ["label", *[f"strip{k}" for k in range(min(lead, 2))]]
    left = strips.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("block", "lo", "hi")])
    right = strips.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("block", "lo", "hi")])
    gap = F.aggregate(F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)), F.lit(0.0), lambda s, x: s + x * x)
    pairs = left.join(right, keys).where("block_a <= block_b").where(gap <= eps * eps * (1 + 1e-9) + 1e-12).select("block_a", "block_b").distinct()
    content = [F.col("ids"), F.col("copies"), F.col("vectors")]
    work = pairs.join(blocks.select(F.col("block").alias("block_b"), F.struct(*content).alias("b")), "block_b")
    work = work.join(blocks.select(F.col("block").alias("block_a"), F.struct(*content).alias("a")), "block_a")

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, second, a, b in zip(*(batch.column(i) for i in range(4)), strict=True):
                ia, ca = (np.frombuffer(a[k].as_py(), np.int64) for k in ("ids", "copies"))
                ib, cb = (np.frombuffer(b[k].as_py(), np.int64) for k in ("ids", "copies"))
                va = np.frombuffer(a["vectors"].as_py(), np.float64).reshape(len(ia), -1)
                vb = np.frombuffer(b["vectors"].as_py(), np.float64).reshape(len(ib), -1)
                turn = rotate[va.shape[1]][:, :lead]
                same = first.as_py() == second.as_py()
                ids = ia if same else np.concatenate([ia, ib])
                shift = 0 if same else len(ia)
                links = np.zeros(len(ids), np.int64)
                label = np.arange(len(ids))
                for p, q in interval_join(va, vb, va @ turn, vb @ turn, eps, cosine):
                    if same:
                        other = p != q
                        p, q = p[other], q[other]
                    links += np.bincount(p, weights=cb[q], minlength=len(ids)).astype(np.int64)
                    if not same:
                        links += np.bincount(q + shift, weights=ca[p], minlength=len(ids)).astype(np.int64)
                    if len(p):
                        # merged with what earlier leaves have linked
                        every = np.arange(len(ids))
                        label = linking.least_reachable(np.concatenate([p, every]), np.concatenate([q + shift, label]), len(ids))
                some = np.flatnonzero(links > 0)
                if len(some):
                    least = ids.copy()
                    np.minimum.at(least, label, ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(least[label[some]])], names=["id", "links", "low"])

    found = scratch.save(work.select("block_a", "block_b", "a", "b").mapInArrow(scratch.lean(join_blocks), "id long, links long, low long"), "links")
    edges = found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    comp = scratch.save(linking.components(edges), "components")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = classes.select("id", "label", "vector", "least", "copies").join(counts, "id", "left").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = linked.join(named, "comp").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    every = valid.join(of_class, ["label", "vector"], "left")
    return every.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
