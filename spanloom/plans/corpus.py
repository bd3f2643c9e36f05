"""The corpus layer over plain tables: texts, sentences, speech, metadata, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lemma(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def pos(word: Column) -> Column:
    return F.when(word.rlike("^[0-9]+$"), "NUM").when(~word.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(word.rlike(r"^\p{Lu}"), "CAP").otherwise("WORD")


#: Attributes that a corpus without annotation derives from the word.
DERIVED = {"lemma": lemma, "pos": pos, "phon": F.lower}


def sentences(docs: DataFrame, attributes: tuple[str, ...] = (), keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row for each line of a text: text_id, s_no, ``keep``, word and further attribute arrays."""
    lines = docs.select(F.col("doc_id").alias("text_id"), *keep, F.posexplode(F.split("text", "\n", -1)).alias("s_no", "line"))
    out = lines.withColumn("word", F.filter(F.split("line", " ", -1), lambda x: x != "")).drop("line")
    for a in attributes:
        out = out.withColumn(a, F.transform("word", DERIVED[a]))
    return out


def tokens(rows: DataFrame, attributes: tuple[str, ...] = ("word",)) -> DataFrame:
    """One row for each token, with its position ``i``."""
    other = [c for c in rows.columns if c not in attributes]
    zipped = F.arrays_zip(*[F.col(a) for a in attributes])
    return rows.select(*[c for c in other if c != "word"], F.posexplode(zipped).alias("i", "t")).select("*", "t.*").drop("t")


def speech(conversations: DataFrame) -> DataFrame:
    """Segments of speech: file, seg, speaker, from, to (strings), line_key, word, and text_id / s_no."""
    return conversations.select(
        F.col("conv_id").alias("file"), F.col("turn").alias("seg"), F.col("role").alias("speaker"), F.col("turn").cast("string").alias("from"), (F.col("turn") + 1).cast("string").alias("to"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("line_key"), F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\t\r]", " "), " ", -1), lambda x: x != "").alias("word"),
        F.col("conv_id").alias("text_id"), F.col("turn").alias("s_no"),
    )


#: Metadata of the texts by type.
TYPES = {"tid": "text", "lang": "text", "source": "text", "quality": "boolean", "toxic": "boolean", "size": "integer"}


def texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of metadata for each text."""
    flag = lambda c: F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no").alias(c)
    own = docs.select(F.col("doc_id").alias("text_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("tid"), "lang", "source", F.floor(F.col("n_chars") / 1000).cast("int").alias("size"))
    return own.join(labels.select(F.col("doc_id").alias("text_id"), flag("quality"), flag("toxic")), "text_id", "left")


def numbered(rows: DataFrame, by: str, key: str, width: int = 1 << 16) -> DataFrame:
    """Adds k, the rank (from 1) of whole-numbered ``key`` within ``by``.

    Ranked inside ranges of ``width`` keys; what the ranges before hold is added, and only one
    row for each range and ``by`` meets in one order.
    """
    from pyspark.sql import Window

    cut = rows.withColumn("__b", F.floor(F.col(key) / width))
    held = cut.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(by, "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__b").orderBy(key))
    return cut.withColumn("__k", inside).join(held, [by, "__b"]).withColumn("k", F.col("__k") + F.col("__before")).drop("__b", "__k", "__before")


def positions(rows: DataFrame) -> DataFrame:
    """Adds start, the position of a sentence's first token in its text."""
    from pyspark.sql import Window

    before = F.sum(F.size("word")).over(Window.partitionBy("text_id").orderBy("s_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0)))


def alignment(docs: DataFrame, first: str, second: str) -> DataFrame:
    """The k-th text of one language beside the k-th of another, line by line."""
    ranked = numbered(docs.where(F.col("lang").isin(first, second)).select("lang", "doc_id", F.size(F.split("text", "\n", -1)).alias("n")), "lang", "doc_id")
    a = ranked.where(F.col("lang") == first).select("k", F.col("doc_id").alias("text_id"), F.col("n").alias("na"))
    b = ranked.where(F.col("lang") == second).select("k", F.col("doc_id").alias("other_text_id"), F.col("n").alias("nb"))
    lines = a.join(b, "k").withColumn("s_no", F.explode(F.sequence(F.lit(0), F.least("na", "nb") - 1)))
    return lines.select("text_id", "s_no", "other_text_id", F.col("s_no").alias("other_s_no"))
