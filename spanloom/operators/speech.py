"""Speech corpora: segments, speakers, media objects and player windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_segments(lines: DataFrame) -> DataFrame:
    """Segments of marked-up hit lines (column ``line``), in order: seg, from, to, speaker,
    line_key, said, is_match.  A segment's times are repeated for each of its speakers."""
    segment = r"(?s)<sync_time ([\d.]+)>\s*<sync_end ([\d.]+)>(.*?)</sync_end>\s*</sync_time>"
    parts = lines.withColumn("__all", F.regexp_extract_all("line", F.lit(segment), F.lit(0)))
    each = parts.select("*", F.posexplode("__all").alias("seg", "__one")).drop("__all")
    timed = each.withColumn("from", F.regexp_extract("__one", segment, 1)).withColumn("to", F.regexp_extract("__one", segment, 2)).withColumn("__body", F.regexp_extract("__one", segment, 3))
    turn = r"(?s)<who_name ([^>]*)>(.*?)</who_name>"
    spoken = timed.select("*", F.posexplode(F.regexp_extract_all("__body", F.lit(turn), F.lit(0))).alias("nth", "__turn"))
    said = F.regexp_extract("__turn", turn, 2)
    return spoken.select(
        *lines.columns, "seg", "nth", "from", "to", F.regexp_extract("__turn", turn, 1).alias("speaker"), F.regexp_extract("__turn", r"<who_line_key ([^>]*)>", 1).alias("line_key"),
        F.trim(F.regexp_replace(said, r"</?who_line_key[^>]*>", "")).alias("said"), said.rlike(r"\{\{|\}\}").alias("is_match"),
    )


def media_objects(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each hit: its file's lines as an array of structs, the hit's line and bounds.

    ``hits``: (file, seg); ``segments``: (file, seg, speaker, from, to, word).
    """
    lines = segments.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seg", "speaker", "from", "to", "word"))).alias("lines"))
    joined = hits.join(lines, "file")
    annotation = F.transform("lines", lambda x: F.struct(x["speaker"].alias("speaker"), x["word"].alias("line"), x["from"].alias("from"), x["to"].alias("to"), (x["seg"] == F.col("seg")).alias("is_match")))
    return joined.select(
        "file", "seg", annotation.alias("annotation"), (F.array_position(F.transform("lines", lambda x: x["seg"]), F.col("seg")) - 1).cast("int").alias("hit_line"),
        F.get("lines", F.lit(0))["from"].alias("start_at"), F.get("lines", F.size("lines") - 1)["to"].alias("end_at"), F.lit(0).alias("min_start"), (F.size("lines") - 1).alias("max_end"),
    )


def player_window(objects: DataFrame, lines: int | str = 0) -> DataFrame:
    """Adds ``window_start``, ``window_end`` (line numbers) and ``window``: ``lines`` on each side of
    the hit's line, clamped; ``all``: everything; 0: the line alone."""
    if lines == "all":
        lo, hi = F.col("min_start"), F.col("max_end")
    else:
        lo, hi = F.greatest(F.col("hit_line") - int(lines or 0), "min_start"), F.least(F.col("hit_line") + int(lines or 0), "max_end")
    out = objects.withColumn("window_start", lo).withColumn("window_end", hi)
    return out.withColumn("window", F.slice("annotation", F.col("window_start") + 1, F.col("window_end") - F.col("window_start") + 1))


def overlapping(objects: DataFrame) -> DataFrame:
    """Adds ``overlaps``: lines outside the window whose time overlaps with the window's."""
    start, stop = F.get("annotation", F.col("window_start"))["from"].cast("double"), F.get("annotation", F.col("window_end"))["to"].cast("double")
    outside = lambda x, i: ((i < F.col("window_start")) | (i > F.col("window_end"))) & (x["from"].cast("double") < stop) & (x["to"].cast("double") > start)
    return objects.withColumn("overlaps", F.filter("annotation", outside))
