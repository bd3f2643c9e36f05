"""Streaming ingest of metadata rows: an extension, for corpora that keep growing.

Files that arrive in a folder are read as a stream, cleaned like a batch import
and appended by corpus; a watermark on arrival drops rows that were sent twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def metadata_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    lines = spark.readStream.text(folder).withColumn("arrived", F.current_timestamp())
    cells = F.split("value", "\t", -1)
    clean = [F.when(~F.trim(F.get(cells, F.lit(k))).isin("", r"\N"), F.trim(F.get(cells, F.lit(k)))).alias(c) for k, c in enumerate(columns)]
    rows = lines.where("value <> ''").select("arrived", *clean)
    return rows.withWatermark("arrived", "10 minutes").dropDuplicatesWithinWatermark(["tid"])


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.drop("arrived").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
