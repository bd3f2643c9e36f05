"""Counts over hits: frequency lists, groups, places, corpus parts, value ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequencies(hits: DataFrame, attribute: str = "word") -> DataFrame:
    """(form, freq) of an attribute of the first token of the match, most frequent first."""
    return hits.groupBy(F.get(F.col(attribute), F.col("first")).alias("form")).agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "form")


def group_counts(hits: DataFrame, form: Column, speaker: Column) -> DataFrame:
    """(phon, who_name, freq)."""
    return hits.groupBy(form.alias("phon"), speaker.alias("who_name")).agg(F.count("*").alias("freq"))


def by_place(groups: DataFrame, places: DataFrame) -> DataFrame:
    """(place, phon, freq): a place's total where phon is null; one pass for both levels.

    ``places``: (who_name, place), several for a speaker resolved to the greatest.
    Speakers without a place drop out.
    """
    of = places.where("place is not null and place <> ''").groupBy("who_name").agg(F.max("place").alias("place"))
    return groups.join(of, "who_name").groupingSets([["place"], ["place", "phon"]], "place", "phon").agg(F.sum("freq").alias("freq"), F.grouping("phon").alias("total"))


def tid_places(cells: DataFrame, tids: list[str] | None = None, place: str = "place") -> DataFrame:
    """(who_name, place): the place of each text's tid, the greatest if there are several.

    ``cells``: (text_id, category, value); ``tids``: these only.
    """
    named = cells.where(F.col("category") == "tid").select("text_id", F.col("value").alias("who_name"))
    if tids is not None:
        named = named.where(F.col("who_name").isin(tids))
    at = cells.where(F.col("category") == place).select("text_id", F.col("value").alias("place"))
    return named.join(at, "text_id").groupBy("who_name").agg(F.max("place").alias("place"))


def total_width(images: DataFrame, key: str = "clip", width: str = "width") -> DataFrame:
    """(key, images, width): the images of a clip side by side."""
    return images.groupBy(key).agg(F.count("*").alias("images"), F.sum(width).alias("width"))


def legend(groups: DataFrame) -> DataFrame:
    """Forms for a map's legend; the undefined one is left out."""
    return groups.where("phon <> '_'").groupBy("phon").agg(F.sum("freq").alias("freq"))


def missing_places(places: DataFrame, coordinates: DataFrame) -> DataFrame:
    return places.select("place").distinct().join(coordinates, "place", "left_anti")


def part_counts(hits: DataFrame, part: str) -> DataFrame:
    return hits.groupBy(part).agg(F.count("*").alias("hits"))


def range_statistics(samples: DataFrame, start: int, stop: int, value: str = "value") -> DataFrame:
    """min, avg (two decimals) and max of values with x in [start, stop], reversed bounds too."""
    lo, hi = min(start, stop), max(start, stop)
    v = F.col(value)
    return samples.where(F.col("x").between(lo, hi) & v.isNotNull()).agg(F.min(v).alias("min"), (F.round(F.avg(v), 2) + F.lit(0.0)).alias("avg"), F.max(v).alias("max"))


def formant_statistics(samples: DataFrame, start: int, stop: int, count: int = 4) -> DataFrame:
    """The same for each of the first ``count`` entries of ``formants``."""
    lo, hi = min(start, stop), max(start, stop)
    each = samples.where(F.col("x").between(lo, hi)).select(F.posexplode(F.slice("formants", 1, count)).alias("formant", "v")).where("v is not null")
    return each.groupBy("formant").agg(F.min("v").alias("min"), (F.round(F.avg("v"), 2) + F.lit(0.0)).alias("avg"), F.max("v").alias("max"))
