"""From shared signatures to connected components, without unbounded groups.

Every step is a shuffle on a signature, a pair or a vertex, and streams over
sorted rows, so that a signature held by a third of all rows costs one pass
and constant memory.  No group is ever collected or expanded into all pairs:
buckets of up to ``small`` members give all their pairs, larger ones a star
around their least member plus membership rows.  What the stars have not linked is
compared block by block inside the groups that shared signatures make, so that a
member's content is sent once for each block of its group and not once for each
partner; blocks of one component are never compared with each other.  As a table grows,
chance candidates join such groups to one that holds most members; a group is
therefore taken apart into the stars of its links where that sends less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .texthash import mix

BLOCK, BYTES, WIDTH, PART = 1024, 4 << 20, 4096, 1 << 20  # members and bytes of a block, columns and numbers handled at once
ALONE = 250_000  # edges that one task takes
TIMES = 4  # that all contents are sent at once, on average
BITS = 1 << 28  # of a bitmap of ids at most

_OUT = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("n", pa.int32())])


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def bucket_rows(small: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows (sig, id) sorted by both; gives pairs (x, y, n) with the number n > 0 of
    signatures that they share there, and members (sig, id, 0) of large buckets.

    An odd signature counts as ``threshold`` ones.
    """

    def pairs(parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            sig, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((y, x))
            x, y, n = x[order], y[order], np.where(sig[order] & 1, threshold, 1)
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(new)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(y[at]), pa.array(np.add.reduceat(n, at).astype(np.int32))], schema=_OUT)

    def members(parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            sig, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids), pa.array(np.zeros(len(ids), np.int32))], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0, ids0 = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the open bucket, or its last row once it is large
        large = None  # least member of the open bucket, if that is large
        for batch in batches:
            sig = np.concatenate([sig0, _numbers(batch.column(0))])
            ids = np.concatenate([ids0, _numbers(batch.column(1))])
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids = sig[fresh], ids[fresh]
            if not len(sig):
                continue
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(np.append(starts, len(sig)))
            linked, hot = [], []

            def star(lo: int, hi: int, least: int, linked=linked, sig=sig, ids=ids) -> None:
                linked.append((sig[lo:hi], np.full(hi - lo, least), ids[lo:hi]))

            closed = np.ones(len(starts), bool)
            closed[-1] = False
            if large is not None:
                k = sizes[0]
                star(1, k, large)
                hot.append((sig[1:k], ids[1:k]))
                closed[0] = False
            rows = np.repeat(closed & (sizes > 1) & (sizes <= small), sizes)
            s, i = sig[rows], ids[rows]
            for d in range(1, small):
                same = s[d:] == s[:-d] if len(s) > d else np.zeros(0, bool)
                if not same.any():
                    break
                linked.append((s[d:][same], i[:-d][same], i[d:][same]))
            for b in np.flatnonzero(closed & (sizes > small)):
                lo, hi = starts[b], starts[b] + sizes[b]
                star(lo + 1, hi, ids[lo])
                hot.append((sig[lo:hi], ids[lo:hi]))
            last = starts[-1]
            if len(starts) > 1:
                large = None
            if large is None and sizes[-1] > small:
                large = ids[last]
                star(last + 1, len(sig), large)
                hot.append((sig[last:], ids[last:]))
            cut = len(sig) - 1 if large is not None else last
            sig0, ids0 = sig[cut:], ids[cut:]
            yield from pairs(linked)
            yield from members(hot)
        if large is None and len(ids0) > 1:
            a, b = np.triu_indices(len(ids0), 1)
            yield from pairs([(sig0[a], ids0[a], ids0[b])])

    return run


def candidates(sigs: DataFrame, small: int = 16, threshold: int = 1) -> DataFrame:
    """(x, y, n) of signature rows (sig, id); one shuffle, on the signature."""
    ordered = sigs.select("sig", "id").repartition("sig").sortWithinPartitions("sig", "id")
    return ordered.mapInArrow(scratch.lean(bucket_rows(small, threshold)), "x long, y long, n int")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges: (vertex, least vertex of its tree), once for each vertex."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while (up := parent.get(top, top)) != top:
            top = up
        while v != top:
            parent[v], v = top, parent.get(v, v)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(v) for v in list(parent)], pa.int64())], names=["id", "comp"])


def components(edges: DataFrame, rounds: int = 60, most: int = ALONE) -> DataFrame:
    """(id, comp) for each vertex of ``edges`` (a, b): comp is the least vertex reachable.

    Union-find inside each partition first.  If that leaves at most ``most`` edges, which
    is counted, one task ends it in the same way.  Else there are rounds of large star and
    small star until the edge set is a set of stars around least vertices.
    The least neighbours are written before they are joined, so that the rows of a
    star's centre, which many vertices share, are a plain join's that Spark can split.
    Raises if ``rounds`` are not enough.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").mapInArrow(scratch.lean(_forest), "id long, comp long").where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")), "forest")
    mark = None
    if edges.limit(most + 1).count() <= most:
        stars = scratch.save(edges.coalesce(1).mapInArrow(scratch.lean(_forest), "id long, comp long"), "stars")
        scratch.drop(edges)
        return stars
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(sized(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = scratch.save(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "down")
        scratch.drop(least)
        least = scratch.save(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(sized(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        nxt = scratch.save(small.where("a <> b").distinct(), "stars")
        for old in (edges, down, least):
            scratch.drop(old)
        edges = nxt
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components: not stable after {rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")).union(
        edges.groupBy(F.col("b").alias("id")).agg(F.min("b").alias("comp"))
    )


def labelled(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Adds cx and cy, the components of x and y (themselves where they have none)."""
    cx = comp.select(F.col("id").alias("x"), F.col("comp").alias("cx"))
    cy = comp.select(F.col("id").alias("y"), F.col("comp").alias("cy"))
    joined = pairs.join(cx, "x", "left").join(cy, "y", "left")
    return joined.withColumn("cx", F.coalesce("cx", "x")).withColumn("cy", F.coalesce("cy", "y"))


def sized(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A saved table of a few numbers a row, with a broadcast hint if it has been counted to be
    at most ``most`` rows; beyond that, Spark shuffles both sides."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


class Among:
    """Says of numbers, in any task, whether they are ids of a saved table (id).

    Up to ``most`` ids, which are counted, are sent to all tasks in eight bytes each, where a
    broadcast join would send rows.  More become a bitmap of two places for each id,
    which also says yes to a few others (of 16 bits for each id about 1 in 70), never no to an id.
    """

    def __init__(self, ids: DataFrame, most: int = 1_000_000):
        self.exact = ids.limit(most + 1).count() <= most
        if self.exact:
            found = np.unique(np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in ids.select("id").toArrow().column(0).chunks)]))
        else:
            found = _bitmap(ids, min(BITS, 1 << (16 * ids.count() - 1).bit_length()))
        self.shared = ids.sparkSession.sparkContext.broadcast(found)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        known = self.shared.value
        if not self.exact:
            return np.logical_and.reduce([known[p >> 3] >> (p & 7).astype(np.uint8) & np.uint8(1) for p in _places(values, 8 * len(known))]).astype(bool)
        place = np.searchsorted(known, values)
        place[place == len(known)] = 0
        return known[place] == values if len(known) else np.zeros(len(values), bool)


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of a bitmap for each value; ``bits`` is a power of two."""
    mixed = mix(values.view(np.uint64) ^ np.uint64(0x8CB92BA72F3D8DD7))
    return [(half & np.uint64(bits - 1)).astype(np.int64) for half in (mixed, mixed >> np.uint64(32))]


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """The bytes of a bitmap of the ids' places, put together by Spark in portions of 4,096 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(_places(np.ascontiguousarray(_numbers(batch.column(0))), bits))
            yield pa.RecordBatch.from_arrays([pa.array(place + 1)], names=["place"])  # Spark's count from 1

    places = ids.select("id").mapInArrow(scratch.lean(run), "place long")
    portions = places.groupBy(F.expr("bitmap_bucket_number(place)").alias("nth")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bytes"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for nth, portion in portions.collect():
        out[(nth - 1) * 4096 : nth * 4096] = np.frombuffer(portion, np.uint8)
    return out[: bits // 8]


def similar(sets_a: list[np.ndarray], sets_b: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs (rows, columns) of two blocks of sets of distinct numbers have Jaccard >= num/den."""
    size_a, size_b = (np.array([len(x) for x in part]) for part in (sets_a, sets_b))
    total, rows = int(size_a.sum() + size_b.sum()), len(size_a) + len(size_b)
    every = np.concatenate([*sets_a, *sets_b])
    owners = np.repeat(np.arange(rows, dtype=np.int32), np.concatenate([size_a, size_b]))
    both = np.zeros((len(size_a), len(size_b)), np.float32)
    # by residue, so that the sort's temporaries are those of a part of all numbers
    parts = -(-total // PART)
    residue = ((every >> np.uint64(24)) % np.uint64(parts)).astype(np.int32) if parts > 1 else None
    for r in range(parts):
        mine = slice(None) if residue is None else residue == r
        _, at, often = np.unique(every[mine], return_inverse=True, return_counts=True)
        shared = often[at] > 1
        column = np.cumsum(often > 1) - 1
        owner, column, width = owners[mine][shared], column[at[shared]], int((often > 1).sum())
        for lo in range(0, width, WIDTH):
            here = (column >= lo) & (column < lo + WIDTH)
            marks = np.zeros((rows, min(WIDTH, width - lo)), np.float32)
            marks[owner[here], column[here] - lo] = 1
            both += marks[: len(size_a)] @ marks[len(size_a) :].T
    both = np.rint(both).astype(np.int64)
    return (both > 0) & (den * both >= num * (size_a[:, None] + size_b[None, :] - both))


def least_reachable(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """The least vertex reachable from each of 0..n-1 over edges (p, q)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def across(links: DataFrame, comp: DataFrame | None, known: DataFrame | None, prepare: Callable[[DataFrame], DataFrame], as_sets: Callable[[list, list], tuple[list, list]], num: int, den: int) -> DataFrame:
    """Links (a, b) between different components, among ids that candidate links connect.

    ``links``: (a, b).  ``known``: a saved table of contents, to which only those that it lacks
    are added.  What the links connect forms groups; a group is dealt into blocks of
    about ``BLOCK`` ids or ``BYTES`` of content by hash, large components by themselves.
    Each pair of its blocks, but those of one component, is one piece of work, which
    streams by as rows and returns the links of a forest over components.  A group's rows
    are sent as often as it has blocks; where its stars, each a least id with
    all that links reach from it, have fewer rows to send, they are groups instead.  A bucket's
    members are all in the star of the least, so each two that share a signature still meet.
    What is more than ``TIMES`` the contents is sent in several passes.
    """
    groups = components(links).withColumnRenamed("comp", "grp")
    if comp is not None:
        groups = groups.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    else:
        groups = groups.withColumn("comp", F.col("id"))
    members = scratch.save(groups, "grouped")
    several = scratch.save(members.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp"), "several")
    members = members.join(sized(several), "grp")
    ids = scratch.save(members.select("id"), "members")
    lacking = ids if known is None else scratch.save(ids.join(known.select("id"), "id", "left_anti"), "lacking")
    parts = [known.join(sized(ids), "id", "left_semi")] if known is not None else []
    if known is None or lacking.take(1):
        parts.append(prepare(lacking))
    column = [c for c in parts[0].columns if c != "id"][0]
    contents = [p.select("id", F.col(column).alias("content")) for p in parts]
    prepared = scratch.save(contents[0] if len(contents) == 1 else contents[0].union(contents[1]), "contents")
    scratch.release(prepared.sparkSession)
    weight = F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BYTES)

    def weigh(members: DataFrame) -> DataFrame:
        weighed = members.join(prepared.select("id", F.length("content").alias("bytes")), "id").groupBy("grp", "comp").agg(F.count("*").alias("n"), weight.alias("weight"))
        return scratch.save(weighed.withColumn("own", F.col("weight") >= 0.5), "weights")

    weighed = weigh(members)
    stars = _stars(links, members, weighed)
    if stars is not None:
        members = scratch.save(stars, "apart")
        weighed = weigh(members)
    shared = weighed.where("not own").groupBy("grp").agg(F.ceil(F.sum("weight")).cast("int").alias("shared"))
    dealt = members.join(sized(weighed), ["grp", "comp"]).join(sized(scratch.save(shared, "shared")), "grp", "left")
    # a block: the component that has it for itself or the least long, and a number
    alone = F.when(F.col("own"), F.col("comp")).otherwise(F.lit(-(1 << 63)))
    nth = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("id")).otherwise(F.col("comp"))), F.when(F.col("own"), F.ceil("weight")).otherwise(F.col("shared")).cast("long"))
    dealt = scratch.save(dealt.select("grp", "id", "comp", F.struct("own", alone.alias("of"), nth.cast("int").alias("nth")).alias("block")), "dealt")
    here = dealt.groupBy("grp", "block").agg(F.count("*").alias("n"))
    first, second = here.select("grp", F.col("block").alias("i")), here.select("grp", F.col("block").alias("j"))
    pairs = first.join(second, "grp").where("i <= j and not (i.own and j.own and i.of = j.of)")
    pairs = scratch.save(pairs.withColumn("work", F.monotonically_increasing_id()), "work")
    side = pairs.select("work", "grp", F.lit(0).alias("side"), F.col("i").alias("block")).union(pairs.where("i <> j").select("work", "grp", F.lit(1), "j"))
    side = scratch.save(side, "sides")
    sent = side.join(here, ["grp", "block"]).agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-sent // (TIMES * max(1, prepared.count()))))
    tasks = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def forest(sides: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        p, q = sides[0], sides[1] or sides[0]
        comp_p, comp_q = np.array([r[0] for r in p], np.int64), np.array([r[0] for r in q], np.int64)
        near = similar(*as_sets([r[1] for r in p], [r[1] for r in q]), num, den) & (comp_p[:, None] != comp_q[None, :])
        x, y = np.nonzero(near)
        if len(x):
            nodes, at = np.unique(np.concatenate([comp_p[x], comp_q[y]]), return_inverse=True)
            root = least_reachable(at[: len(x)], at[len(x) :], len(nodes))
            child = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_work, sides = None, ([], [])
        for batch in batches:
            work, side, of = (batch.column(k).to_pylist() for k in range(3))
            for k, content in enumerate(batch.column(3)):
                if work[k] != open_work:
                    if open_work is not None:
                        yield from forest(sides)
                    open_work, sides = work[k], ([], [])
                sides[side[k]].append((of[k], content.as_py()))
        if open_work is not None:
            yield from forest(sides)

    found = []
    for nth in range(passes):
        # by hash, as numbers of work have the partition in their upper bits
        mine = side if passes == 1 else scratch.save(side.where(F.pmod(F.xxhash64("work"), F.lit(passes)) == nth), "pass")
        rows = dealt.join(prepared, "id").join(sized(mine), ["grp", "block"])
        rows = rows.select("work", "side", "comp", "content").repartition(tasks, "work").sortWithinPartitions("work", "side")
        found.append(scratch.save(rows.mapInArrow(scratch.lean(run), "a long, b long"), "across"))
        scratch.release(prepared.sparkSession)
    scratch.drop(prepared)
    return reduce(DataFrame.union, found)


def _stars(links: DataFrame, members: DataFrame, weighed: DataFrame) -> DataFrame | None:
    """``members`` (grp, id, comp) with groups replaced by the stars of their links (a, b) where
    those send fewer rows, or None if that is so nowhere.

    ``weighed``: (grp, comp, n, weight, own).  A star's number is its least id, which is in no other group.
    """
    blocks = F.sum(F.when(F.col("own"), F.ceil("weight")).otherwise(0)) + F.ceil(F.sum(F.when(F.col("own"), 0).otherwise(F.col("weight"))))
    cut = weighed.groupBy("grp").agg((F.sum("n") * blocks).alias("rows"), (F.sum("weight") / F.sum("n")).alias("each"), blocks.alias("blocks")).where("blocks > 1")
    cut = scratch.save(cut.select("grp", "rows", "each"), "cut")
    if not cut.take(1):
        return None
    members = members.select("grp", "id", "comp")
    edges = links.select(F.least("a", "b").alias("star"), F.greatest("a", "b").alias("id")).where("star <> id").distinct()
    within = scratch.save(edges.join(members.join(sized(cut), "grp").select("grp", F.col("id").alias("star"), "rows", "each"), "star"), "within")
    of_star = within.groupBy("grp", "rows", "each", "star").agg((F.count("*") + 1).alias("n"))
    less = of_star.groupBy("grp", "rows").agg(F.sum(F.col("n") * F.ceil(F.col("n") * F.col("each"))).alias("apart")).where("apart < rows")
    apart = scratch.save(less.select("grp"), "less")
    if not apart.take(1):
        return None
    within = within.join(sized(apart), "grp")
    rows = within.select("star", "id").union(within.select("star", F.col("star").alias("id")).distinct())
    stars = scratch.save(rows.join(members.select("id", "comp"), "id").select(F.col("star").alias("grp"), "id", "comp"), "stars")
    several = stars.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
    return members.join(sized(apart), "grp", "left_anti").union(stars.join(sized(scratch.save(several, "several")), "grp").select("grp", "id", "comp"))


def link(
    sigs: Iterable[DataFrame],
    prepare: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    as_sets: Callable[[list, list], tuple[list, list]],
    num: int,
    den: int,
    small: int = 16,
    threshold: int = 1,
) -> DataFrame | None:
    """Components (id, comp) of the graph of pairs that share ``threshold`` signatures and
    have a Jaccard similarity of num/den or more.

    ``sigs``: tables (sig, id), no signature in two of them; one after the other is shuffled
    and its shuffle files released.  ``prepare`` turns ids into (id, content), which
    ``verify(pairs, prepared)`` joins and ``as_sets`` makes sets of numbers of, for two
    blocks at a time.  Returns None if there is no link.
    """
    comp: DataFrame | None = None

    def linked(new: DataFrame) -> None:
        """Adds links (a, b) to ``comp``; a and b are components as far as there are any."""
        nonlocal comp
        new = scratch.save(new, "edges")
        scratch.release(new.sparkSession)
        if new.take(1):
            more = components(new)
            if comp is not None:  # components of components, and of ids that had none
                more = scratch.save(more, "merged")
                up = more.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
                known = comp.join(up, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
                more = known.union(more.join(comp.select("id"), "id", "left_anti").select("id", "comp"))
            comp = scratch.save(more, "components")
            scratch.release(new.sparkSession)

    passes = []
    for part in sigs:
        passes.append(scratch.save(candidates(part, small, threshold), "candidates"))
        scratch.release(part.sparkSession)
    found = reduce(DataFrame.union, passes)
    pairs = scratch.save(found.where("n > 0").groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= threshold), "pairs")
    # first the one partner of each member with which it shares most signatures
    first = scratch.save(pairs.groupBy("y").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("x")).select("x", "y"), "first")
    prepared = None
    if first.take(1):
        # of all candidates, as the second comparison needs nearly all of them again
        prepared = scratch.save(prepare(pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()), "prepared")
        scratch.release(found.sparkSession)
        linked(verify(sized(first), prepared).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # then what is left between components: other pairs, and members of large buckets
    rest = pairs.select("x", "y").join(first, ["x", "y"], "left_anti")
    hot = found.where("n = 0").select(F.col("x").alias("sig"), F.col("y").alias("id"))
    if comp is not None:
        rest = labelled(rest, comp).where("cx <> cy")
        hot = hot.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    else:
        hot = hot.withColumn("comp", F.col("id"))
    # aggregated before they meet, as one signature may have a third of all members
    spots = scratch.save(hot.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig"), "spots")
    hot = hot.join(sized(spots), "sig").select("sig", "id")
    if threshold > 1:
        # an id that shares fewer signatures than that, with anyone at all, has no partner among them
        lone = found.where("n > 0").select(F.col("x").alias("id"), "n").union(found.where("n > 0").select(F.col("y").alias("id"), "n")).groupBy("id").agg(F.sum("n").alias("n"))
        own = hot.groupBy("id").agg(F.sum(F.when(F.col("sig") % 2 != 0, threshold).otherwise(1)).alias("h"))
        able = own.join(lone, "id", "left").where(F.col("h") + F.coalesce("n", F.lit(0)) >= threshold).select("id")
        hot = hot.join(able, "id", "left_semi")
    hot = scratch.save(hot, "hot")
    least = scratch.save(hot.groupBy("sig").agg(F.min("id").alias("b")), "least")
    hot = hot.join(sized(least), "sig").select(F.col("id").alias("a"), "b")
    open_links = scratch.save(rest.select(F.col("x").alias("a"), F.col("y").alias("b")).union(hot).where("a <> b").distinct(), "open")
    for old in passes:
        scratch.drop(old)
    scratch.release(open_links.sparkSession)
    if open_links.take(1):
        linked(across(open_links, comp, prepared, prepare, as_sets, num, den))
    for old in (prepared, first, pairs):
        if old is not None:
            scratch.drop(old)
    return comp
