"""Concordance lines: context, sorting, paging, progressive search, saved results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words_joined
from .match import ORDER

PAGE = 50


def word_slice(words: Column, first: Column, count: Column) -> Column:
    return words_joined(F.slice(words, first + 1, F.greatest(count, F.lit(0))))


def kwic(hits: DataFrame) -> DataFrame:
    """Adds left, match and right: the words of the sentence before, in and after the match."""
    w = F.col("word")
    return hits.withColumns({
        "left": word_slice(w, F.lit(0), F.col("first")),
        "match": word_slice(w, F.col("first"), F.col("last") - F.col("first") + 1),
        "right": word_slice(w, F.col("last") + 1, F.size(w) - F.col("last") - 1),
    })


def with_context(hits: DataFrame, sentences: DataFrame, size: int = 1) -> DataFrame:
    """Adds ``before`` and ``after``: the ``size`` - 1 sentences on each side in the same text.

    Equi-joins on sentence numbers, so only neighbours of hits are moved.
    """
    if size <= 1:
        return hits.withColumns({"before": F.lit(""), "after": F.lit("")})
    wanted = hits.select("text_id", F.explode(F.sequence(F.col("s_no") - size + 1, F.col("s_no") + size - 1)).alias("n"), F.col("s_no")).distinct()
    near = sentences.select("text_id", F.col("s_no").alias("n"), F.array_join("word", " ").alias("line")).join(wanted, ["text_id", "n"])
    pick = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "line")))), lambda x: x["line"]), " ")
    around = near.groupBy("text_id", "s_no").agg(pick(F.col("n") < F.col("s_no")).alias("before"), pick(F.col("n") > F.col("s_no")).alias("after"))
    return hits.join(around, ["text_id", "s_no"], "left")


def sort_key(by: str) -> Column:
    """position, match, left, right: one token, in binary order; headword_len: a column."""
    keys = {"match": F.get("word", F.col("first")), "left": F.when(F.col("first") > 0, F.get("word", F.col("first") - 1)), "right": F.get("word", F.col("last") + 1), "headword_len": F.col("headword_len") if by == "headword_len" else None}
    if by not in keys:
        raise ValueError(f"cannot sort by {by}")
    return keys[by]


def with_headword_len(hits: DataFrame, region: tuple[Column, Column]) -> DataFrame:
    """Adds headword_len, the number of tokens of the headword around the match."""
    return hits.withColumn("headword_len", region[1] - region[0] + 1)


def search_order(queries: list[dict], by: str = "position") -> str:
    """A headword search is sorted by the headword's length, whatever was asked for."""
    return "headword_len" if any(q.get("headword_search") for q in queries) else by


def first_of(rows: DataFrame, *order: str) -> DataFrame:
    """The first row in an order."""
    return rows.orderBy(*order).limit(1)


def sort(hits: DataFrame, by: str = "position") -> DataFrame:
    """Ties, and ``position``, in corpus order; an absent neighbour first."""
    keys = [] if by == "position" else [sort_key(by).asc_nulls_first()]
    return hits.orderBy(*keys, *ORDER)


def page(hits: DataFrame, number: int, size: int = PAGE, by: str = "position") -> DataFrame:
    """Page ``number`` (from 1) of the sorted hits."""
    return sort(hits, by).offset((number - 1) * size).limit(size)


def rows(hits: DataFrame, start: int, stop: int, by: str = "position") -> DataFrame:
    """Rows start..stop, from 0, both included."""
    return sort(hits, by).offset(start).limit(stop - start + 1)


def pages(hits: DataFrame, numbers: list[int], size: int = PAGE, by: str = "position") -> DataFrame:
    """Several pages at once, with ``page``; only rows up to the last page are ranked."""
    first = sort(hits, by).limit(max(numbers) * size)
    keys = [] if by == "position" else [sort_key(by).asc_nulls_first()]
    rank = F.row_number().over(Window.orderBy(*keys, *ORDER))
    return first.withColumn("page", F.floor((rank - 1) / size).cast("int") + 1).where(F.col("page").isin(numbers))


def page_count(hits: int, size: int = PAGE) -> int:
    return -(-hits // size)


def clip_page(number: int, count: int) -> int:
    return max(1, min(number, count))


def step_cut(step: int, size: int = PAGE, max_hits: int | None = None) -> int | None:
    """Progressive search: one page, then 20 pages, then all (up to ``max_hits``)."""
    most = {1: size, 2: 20 * size}.get(step)
    return max_hits if most is None else most if max_hits is None else min(most, max_hits)


def progressive_counts(hits: DataFrame, size: int = PAGE, max_hits: int | None = None) -> DataFrame:
    """(step, hits) of the three steps, from one count."""
    total = hits.agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(step_cut(k, size, max_hits)).cast("long").alias("most")) for k in (1, 2, 3)])
    out = total.select("n", F.inline(steps))
    return out.select("step", F.least("n", F.coalesce("most", "n")).alias("hits"))
