"""A training-corpus pipeline over the ``documents`` table.

Each stage works on all that the one before it has kept, is written as Parquet
and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, line_dedup, linking, ngram_join, packing, quality, scratch
from spanloom.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the cut (operator 4)."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines, exact or near; drops documents that lose all lines (operator 3)."""
    return line_dedup.drop_repeated_lines(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the least doc_id, null last (operator 1).

    Rows are compared and kept one by one, by their texts: a doc_id may be null or
    occur twice.  Of rows of one group and doc_id, one is kept.  Rows without words stay.
    """
    rows = scratch.save(docs.withColumns({"__row": F.monotonically_increasing_id(), "__hash": F.xxhash64("text")}), "rows")
    found = scratch.save(ngram_join.jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id"), "found")
    groups = found.join(rows.select("__row", "doc_id", "__hash"), "__row").groupBy("component_id")
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "__row")).alias("first")).select("first.__row")
    gone = linking.sized(scratch.save(found.select("__row").join(first, "__row", "left_anti"), "gone"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to its edit budget (operator 8)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences by best fit: the pieces with their places (operator 6)."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, MinHash linking and tokenisation have no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.split()[0])
    return docs
