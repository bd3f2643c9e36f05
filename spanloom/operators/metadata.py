"""Text metadata as typed entity-attribute-value tables, and searches in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleMetadataError
from ..functions.text import searched_boolean, shown_boolean, to_integer


def unpivot(texts: DataFrame, types: dict[str, str], key: str = "text_id") -> DataFrame:
    """(key, category, value) of the non-null cells of ``types``' columns."""
    cells = texts.select(key, *[F.col(c).cast("string").alias(c) for c in types])
    return cells.unpivot([key], list(types), "category", "value").where("value is not null")


def value_table(cells: DataFrame, types: dict[str, str]) -> DataFrame:
    """(value_id, category, type, text_value, integer_value, boolean_value), each value once.

    value_id is a hash of category and value: stable, without a global numbering.
    """
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.col("category")]
    found = cells.select("category", "value").distinct().withColumn("type", kind)
    return found.select(
        F.xxhash64("category", "value").alias("value_id"), "category", "type",
        F.when(F.col("type") == "text", F.col("value")).alias("text_value"),
        F.when(F.col("type") == "integer", to_integer(F.col("value"))).alias("integer_value"),
        F.when(F.col("type") == "boolean", ~F.lower("value").isin("no", "false")).alias("boolean_value"),
    )


def shown(values: DataFrame) -> DataFrame:
    """(value_id, category, text) as a picker shows them."""
    text = F.coalesce("text_value", F.col("integer_value").cast("string"), F.when(F.col("boolean_value").isNotNull(), shown_boolean(F.col("boolean_value"))))
    return values.select("value_id", "category", text.alias("text"))


def listed(values: DataFrame, category: str) -> DataFrame:
    """(value_id, text) of a category as a picker lists them, by text."""
    return shown(values.where(F.col("category") == category)).select("value_id", "text").orderBy("text", "value_id")


def linked_values(cells: DataFrame) -> DataFrame:
    """(text_id, value_id): which texts have which values of :func:`value_table`."""
    return cells.select("text_id", F.xxhash64("category", "value").alias("value_id")).distinct()


def matching_ids(cells: DataFrame, types: dict[str, str], selected: dict[str, list[int]]) -> DataFrame:
    """Texts by the ids of values, as a search request has them; see :func:`matching_texts`."""
    links, chosen = linked_values(cells), {c: v for c, v in selected.items() if v}
    if not chosen:
        return links.select("text_id").distinct()
    wanted = value_table(cells, types).where(F.col("value_id").isin([i for v in chosen.values() for i in v])).select("value_id", "category")
    met = links.join(wanted, "value_id").groupBy("text_id").agg(F.count_distinct("category").alias("met"))
    return met.where(F.col("met") == len(chosen)).select("text_id")


def inline(spark, name: str, keys: list) -> DataFrame:
    """A relation of a few keys, each once."""
    return spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"{name} {'long' if all(isinstance(k, int) for k in keys) else 'string'}")


def matching_texts(cells: DataFrame, selected: dict[str, list[str]], key: str = "text_id") -> DataFrame:
    """Texts with one of the selected values in every category: OR within, AND across.

    One pass over the table: the categories met are counted for each text.
    """
    chosen = {c: v for c, v in selected.items() if v}
    wanted = None
    for category, values in chosen.items():
        here = (F.col("category") == category) & F.col("value").isin(list(map(str, values)))
        wanted = here if wanted is None else wanted | here
    if wanted is None:
        return cells.select(key).distinct()
    met = cells.where(wanted).groupBy(key).agg(F.count_distinct("category").alias("met"))
    return met.where(F.col("met") == len(chosen)).select(key)


def restrict(sentences: DataFrame, cells: DataFrame, selected: dict[str, list[str]], check: bool = True) -> DataFrame:
    """Sentences of matching texts, before any matching; no text at all is an error."""
    if not any(selected.values()):
        return sentences
    texts = matching_texts(cells, selected)
    if check and not texts.take(1):
        raise IncompatibleMetadataError(f"no text has {selected}")
    return sentences.join(texts, "text_id", "left_semi")


def constrained_values(cells: DataFrame, category: str, selected: dict[str, list[str]], mode: str = "any") -> DataFrame:
    """Values of ``category`` in texts that have any (or, with ``all``, every category's) of the
    values selected elsewhere; selections in ``category`` itself are ignored."""
    others = {c: v for c, v in selected.items() if c != category and v}
    mine = cells.where(F.col("category") == category)
    if others and mode == "all":
        mine = mine.join(matching_texts(cells, others), "text_id", "left_semi")
    elif others:
        any_of = None
        for c, values in others.items():
            here = (F.col("category") == c) & F.col("value").isin(list(map(str, values)))
            any_of = here if any_of is None else any_of | here
        mine = mine.join(cells.where(any_of).select("text_id"), "text_id", "left_semi")
    return mine.select("value").distinct()


def search_values(values: DataFrame, category: str, query: str) -> DataFrame:
    """Values of a category that a typed text finds, by the category's type; all if it is blank."""
    mine = values.where(F.col("category") == category)
    if not query.strip():
        return mine
    q = F.lit(query)
    return mine.where(
        F.when(F.col("type") == "text", F.contains(F.lower("text_value"), F.lower(q)))
        .when(F.col("type") == "integer", F.col("integer_value") == to_integer(q))
        .otherwise(F.col("boolean_value") == searched_boolean(q))
    )


def text_by_tid(cells: DataFrame, tid: str) -> DataFrame:
    return cells.where((F.col("category") == "tid") & (F.col("value") == tid)).select("text_id").distinct()


def upsert_texts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Texts by tid: known ones keep text_id, new ones get one from their tid; ranges are replaced."""
    if "tid" not in incoming.columns:
        raise ValueError("a tid column is required")
    old = existing.select("tid", F.col("text_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in incoming.columns if c != "tid" and c in existing.columns])
    joined = incoming.join(old, "tid", "full_outer")
    columns = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in existing.columns else F.col(c) for c in incoming.columns if c != "tid"]
    return joined.select(F.coalesce("__id", F.xxhash64("tid")).alias("text_id"), "tid", *columns)


def localized(categories: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """Category names in a locale; the short name, in words, where there is none."""
    names = translations.where(F.col("locale") == locale).select("category_id", F.col("name").alias("__name"))
    own = F.initcap(F.replace("short_name", F.lit("_"), F.lit(" ")))
    return categories.join(names, "category_id", "left").withColumn("name", F.coalesce("__name", own)).drop("__name")


def allowed_corpora(corpora: DataFrame, permissions: DataFrame, user_id: int) -> DataFrame:
    return corpora.join(permissions.where(F.col("user_id") == user_id), "corpus_id", "left_semi")


def corpus_with_categories(corpora: DataFrame, categories: DataFrame, code: str) -> DataFrame:
    """A corpus and its categories as one array (a one-hop traversal)."""
    listed = categories.groupBy("corpus_id").agg(F.array_sort(F.collect_list(F.struct("category_id", "short_name"))).alias("categories"))
    return corpora.where(F.col("code") == code).join(listed, "corpus_id", "left")


def runs(line_keys: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """(basename, line_key_begin, line_key_end) of runs of equal basenames in key order.

    ``lag`` runs inside buckets of keys; a bucket's first row looks at the last row of
    the bucket before it, and a bucket's last run ends before the first of a later one.
    Only one row for each bucket meets in one order.
    """
    from pyspark.sql import Window

    rows = line_keys.select("line_key", "basename").withColumn("__b", F.floor(F.col("line_key") / bucket))
    ends = rows.groupBy("__b").agg(F.max_by("basename", "line_key").alias("__end"), F.max("line_key").alias("__key"))
    ends = ends.withColumn("__prior", F.lag("__end").over(Window.orderBy("__b"))).select("__b", "__prior")
    inside = rows.withColumn("__before", F.lag(F.struct("basename")).over(Window.partitionBy("__b").orderBy("line_key")))
    changed = inside.join(ends, "__b").where(~F.col("basename").eqNullSafe(F.when(F.col("__before").isNull(), F.col("__prior")).otherwise(F.col("__before.basename"))))
    last = rows.agg(F.max("line_key").alias("__last"))
    starts = changed.groupBy("__b").agg(F.min("line_key").alias("__start"))  # one row for each bucket
    later = starts.withColumn("__later", F.lead("__start").over(Window.orderBy("__b"))).select("__b", "__later")
    ended = changed.withColumn("__next", F.lead("line_key").over(Window.partitionBy("__b").orderBy("line_key"))).join(later, "__b").join(F.broadcast(last))  # one row
    return ended.select("basename", F.col("line_key").alias("line_key_begin"), F.coalesce(F.col("__next") - 1, F.col("__later") - 1, F.col("__last")).alias("line_key_end"))


def media_of(keys: DataFrame, media: DataFrame, width: int = 1024) -> DataFrame:
    """Each key's media file: begin <= key <= end, null if none.

    Intervals are cut into buckets of ``width`` keys, so this is an equi-join.
    """
    cut = media.withColumn("__b", F.explode(F.sequence(F.floor(F.col("line_key_begin") / width), F.floor(F.col("line_key_end") / width))))
    here = keys.withColumn("__b", F.floor(F.col("line_key") / width))
    inside = (here["__b"] == cut["__b"]) & (F.col("line_key_begin") <= F.col("line_key")) & (F.col("line_key") <= F.col("line_key_end"))
    return here.join(cut, inside, "left").select(*[here[c] for c in keys.columns], "basename")
