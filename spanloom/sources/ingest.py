"""Readers of a corpus's import files: categories, metadata values, line keys, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import runs

#: Columns of a category file that hold positions and not metadata.
RESERVED = {"id", "startpos", "endpos", "bounds"}


def corpus_code(filename: str) -> str:
    """A package's corpus name: lower case, without ``.zip``, letters and ``_`` only."""
    import re

    return re.sub(r"[^a-z_]", "", re.sub(r"\.zip$", "", filename.lower()))


def categories(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """(position, short_name, name, category_type, value_type) of a tab-separated category file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("position", "line"))
    return read_categories(lines, existing)


def read_categories(lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The same of lines (position, line)."""
    cell = lambda k: F.nullif(F.trim(F.get(F.split("line", "\t"), F.lit(k))), F.lit(""))
    rows = lines.select(
        "position", cell(0).alias("short_name"), F.coalesce(cell(1), F.initcap(cell(0))).alias("name"), F.coalesce(cell(2), F.lit("list")).alias("category_type"), F.coalesce(cell(3), F.lit("text")).alias("value_type"),
    ).where("short_name is not null")
    return rows if existing is None else rows.join(existing.select("short_name"), "short_name", "left_anti")


def values(spark: SparkSession, path: str, columns: list[str], speech: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """The cells of a headerless tab-separated file under ``columns``; empty and ``\\N`` are null.

    In speech data an escaped tab inside ``bounds`` is a blank.
    """
    if "tid" not in columns:
        raise ValueError("a tid column is required")
    lines = spark.read.text(path) if encoding.lower().replace("-", "") == "utf8" else recoded(spark, path, encoding)
    return read_values(lines, columns, speech)


def read_values(lines: DataFrame, columns: list[str], speech: bool = False) -> DataFrame:
    """The same of lines (value)."""
    if "tid" not in columns:
        raise ValueError("a tid column is required")
    # the escaped tab stands in for one that would end the cell; in bounds it is read as a blank
    line = F.replace("value", F.lit("\\\t"), F.lit("\x00")) if speech else F.col("value")
    cells = F.transform(F.split(line, "\t", -1), lambda x: F.replace(x, F.lit("\x00"), F.lit("\\\t"))) if speech else F.split(line, "\t", -1)
    if speech and "bounds" in columns:
        at = columns.index("bounds")
        cells = F.transform(cells, lambda x, k: F.when(k == at, F.replace(x, F.lit("\\\t"), F.lit(" "))).otherwise(x))
    clean = [F.when(~F.trim(F.get(cells, F.lit(k))).isin("", r"\N"), F.trim(F.get(cells, F.lit(k)))).alias(c) for k, c in enumerate(columns)]
    return lines.where("value <> ''").select(*clean)


def recoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of a text file in another character set."""
    return spark.read.option("encoding", encoding).option("sep", "\x00").option("quote", "").csv(path, schema="value string")


def joined_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a database dump; a backslash at a line's end joins it with the next by a blank."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\\\\\\n", " "), "\n")).alias("value")).where("value <> ''")


def line_keys(spark: SparkSession, path: str) -> DataFrame:
    """Runs (basename, line_key_begin, line_key_end) of a file of (line_key, basename)."""
    return runs(spark.read.csv(path, sep="\t", schema="line_key int, basename string"))


def ranges(texts: DataFrame) -> DataFrame:
    """(text_id, start, end): from startpos and endpos, or from a list ``s-e s-e`` in positions."""
    columns = set(texts.columns)
    out = None
    if {"startpos", "endpos"} <= columns:
        out = texts.where("startpos is not null").select("text_id", F.col("startpos").cast("long").alias("start"), F.col("endpos").cast("long").alias("end"))
    if "positions" in columns:
        one = texts.where("positions is not null").select("text_id", F.explode(F.split(F.trim("positions"), r"\s+")).alias("r"))
        spoken = one.select("text_id", F.split_part("r", F.lit("-"), F.lit(1)).cast("long").alias("start"), F.split_part("r", F.lit("-"), F.lit(2)).cast("long").alias("end"))
        out = spoken if out is None else out.union(spoken)
    return out


def write_positions(texts: DataFrame, path: str) -> None:
    ranges(texts).select("start", "end").write.mode("overwrite").csv(path, sep="\t")


def replace_corpus(rows: DataFrame, path: str) -> None:
    """Delete-before-load: only the partitions of the corpora in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(path)


def drop_corpus(spark: SparkSession, path: str, corpus: str) -> None:
    """Removes a corpus's partition."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/corpus={corpus}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dump_table(spark: SparkSession, url: str, table: str, path: str, **options: str) -> None:
    """A table of another database as tab-separated text."""
    spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().write.mode("overwrite").csv(path, sep="\t", nullValue=r"\N")
