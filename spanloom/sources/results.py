"""Saved searches and result sets, and JSON or XML output."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concordance, match


def save_hits(hits: DataFrame, folder: str, search_id: str) -> None:
    """A search's hits as spans, unsorted; every page is sorted when it is read."""
    path = f"{folder}/search_id={search_id}"
    hits.select(*match.ORDER).write.mode("overwrite").parquet(path)


def read_page(spark: SparkSession, sentences: DataFrame, folder: str, search_id: str, start: int, stop: int, by: str = "position") -> DataFrame:
    """Rows start..stop of a saved search as concordance lines.

    By position, only the sentences of the page's own hits are read; other orders
    need the words beside every hit.
    """
    spans = spark.read.parquet(f"{folder}/search_id={search_id}")
    if by == "position":
        chosen = spans.orderBy(*match.ORDER).offset(start).limit(stop - start + 1)
        return concordance.sort(concordance.kwic(sentences.join(F.broadcast(chosen), ["text_id", "s_no"])))
    return concordance.kwic(concordance.rows(sentences.join(spans, ["text_id", "s_no"]), start, stop, by))


def search_record(search_id: str, queries: list[dict], **options) -> dict:
    """A saved search: its queries as JSON and its options."""
    return {"search_id": search_id, "queries": json.dumps(queries), "num_hits": 0, "max_hits": None} | options


def read_queries(searches: DataFrame) -> DataFrame:
    return searches.withColumn("queries", F.from_json("queries", "array<struct<lang:string,query:string,headword_search:boolean>>"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def as_xml(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_xml(F.struct("*")).alias("xml"))


def merged_parameters(first: dict, second: dict) -> dict:
    """The right one wins."""
    return first | second


def bound_sql(template: str, target: str | None = None, **names: str) -> str:
    """A template with its ``#TARGET`` (an id ``#n:m``) and ``&name`` words put in; positional
    parameters stay for ``spark.sql(query, args=[...])``."""
    if target is not None:
        if not re.fullmatch(r"#\d+:\d+", target):
            raise ValueError(f"not an id: {target}")
        template = re.sub(r"#TARGETS?\b", target, template)
    for name, word in names.items():
        if not re.fullmatch(r"\w+", word):
            raise ValueError(f"not a name: {word}")
        template = re.sub(rf"&{name}\b", word, template)
    return template
