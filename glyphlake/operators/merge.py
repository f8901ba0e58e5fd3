"""Merging items that repeat, and spreading merged ones out again.

Groups keep their first member by ``ord``; collections are ordered by it, so no
result depends on the order of a shuffle.  Null texts and paths are values like
any other.  A group's handles are collected into one row, as the format asks;
they are distinct handles of one drawing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.predicates import is_blank, is_non_textual, trim_all


def _ordered(value: Column) -> Column:
    """The values of a group in the order of ``ord``."""
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))), lambda x: x["v"])


def merge_exact(items: DataFrame) -> DataFrame:
    """One row per path, type and exact text: ``path, entity_type, original_text, raw_original_text, item_id, ord, cleaned_text, handles, items``."""
    return items.groupBy("path", "entity_type", "original_text", "raw_original_text").agg(
        F.min_by("item_id", "ord").alias("item_id"),
        F.min("ord").alias("ord"),
        F.min_by("cleaned_text", "ord").alias("cleaned_text"),
        _ordered(F.col("handle")).alias("handles"),
        F.count(F.lit(1)).alias("items"),
    )


def dedup_cleaned(merged: DataFrame) -> DataFrame:
    """Merged rows put together by type and cleaned text; rows without one follow after all groups.

    Adds ``block`` (0 for groups, 1 for rows without a cleaned text) for the order.
    """
    has = ~is_blank(F.col("cleaned_text"))
    groups = merged.where(has).groupBy("path", "entity_type", "cleaned_text").agg(
        F.min_by("item_id", "ord").alias("item_id"),
        F.min("ord").alias("ord"),
        F.min_by("original_text", "ord").alias("original_text"),
        F.flatten(_ordered(F.col("handles"))).alias("handles"),
        F.sum("items").alias("items"),
    )
    rest = merged.where(~has)
    columns = ["path", "entity_type", "cleaned_text", "item_id", "ord", "original_text", "handles", "items"]
    return groups.select(*columns, F.lit(0).alias("block")).unionByName(rest.select(*columns, F.lit(1).alias("block")))


def fan_out(merged: DataFrame) -> DataFrame:
    """One row per handle of each merged row, in its order: ``<columns>, member, handle``."""
    return merged.select("*", F.posexplode("handles").alias("member", "handle"))


def truly_translated(items: DataFrame) -> DataFrame:
    """Rows whose translation is not blank and not the original."""
    return items.where(~is_blank(F.col("translated_text")) & ~F.col("translated_text").eqNullSafe(F.col("original_text")))


def translation_export(items: DataFrame) -> DataFrame:
    """Translated textual rows, the first per path and trimmed cleaned (or original) text: ``path, source, translation, item_id``."""
    source = trim_all(F.coalesce("cleaned_text", "original_text"))
    rows = truly_translated(items).where(~is_non_textual(F.col("original_text"))).withColumn("source", source)
    return rows.groupBy("path", "source").agg(F.min_by("translated_text", "ord").alias("translation"), F.min_by("item_id", "ord").alias("item_id"))


def carry_over(items: DataFrame) -> DataFrame:
    """Blank translations filled from the last row of the path with the same text in small letters, trimmed: ``item_id, translated_text, carried``."""
    key = F.lower(trim_all(F.col("original_text")))
    rows = items.withColumn("key", key)
    known = truly_translated(rows).where("key is not null").groupBy("path", "key").agg(F.max_by("translated_text", "ord").alias("prior"))
    blank = is_blank(F.col("translated_text"))
    joined = rows.join(known, ["path", "key"], "left")
    return joined.select("item_id", F.when(blank, F.coalesce("prior", "translated_text")).otherwise(F.col("translated_text")).alias("translated_text"), (blank & F.col("prior").isNotNull()).alias("carried"))
