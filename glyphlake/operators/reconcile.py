"""Review sheets and agents' edits brought back to the items.

All joins are equi joins on the path and a normalized key.  Where a key occurs
several times the last row wins, as it does in a dictionary that is filled in
order; a join never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.predicates import is_blank, is_non_textual, trim_all
from glyphlake.functions.text import id_string
from glyphlake.operators.orphan_refs import parse_handles


def handle_candidates(items: DataFrame) -> DataFrame:
    """``path, item_id, ord, rank, key``: the handles of an item in the order in which they are tried."""
    handles = F.concat(F.coalesce("cad_handles", F.array().cast("array<string>")), F.array("handle"))
    return items.select("path", "item_id", "ord", F.posexplode(F.transform(handles, lambda h: F.upper(F.trim(h)))).alias("rank", "key")).where("key <> ''")


def sheet_handles(sheet: DataFrame) -> DataFrame:
    """``path, key, row_no, sheet_row_id, translation``: the last row of a sheet that names a handle."""
    keys = F.explode(F.array_union(F.coalesce(parse_handles(F.col("id")), F.array().cast("array<string>")), F.coalesce(parse_handles(F.col("all_handles")), F.array().cast("array<string>"))))
    rows = sheet.select("path", keys.alias("key"), "row_no", "sheet_row_id", "translation")
    last = F.max(F.struct("row_no", "sheet_row_id", "translation")).alias("r")
    return rows.groupBy("path", "key").agg(last).select("path", "key", "r.*")


def import_by_handle(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """``path, item_id, ord, sheet_row_id, translation`` of every item whose handles a sheet row names; its first named handle decides."""
    hits = handle_candidates(items).join(sheet_handles(sheet), ["path", "key"])
    best = F.min(F.struct("rank", "sheet_row_id", "translation")).alias("r")
    return hits.groupBy("path", "item_id", "ord").agg(best).select("path", "item_id", "ord", "r.sheet_row_id", F.when(~is_blank(F.col("r.translation")), F.col("r.translation")).alias("translation"))


def positional_fallback(items: DataFrame, sheet: DataFrame, matched: DataFrame) -> DataFrame:
    """The nth unmatched item of a path takes its nth unused sheet row: ``path, item_id, sheet_row_id, translation``."""
    left = items.select("path", "item_id", "ord").join(matched.select("item_id"), "item_id", "left_anti")
    rows = sheet.select("path", "row_no", "sheet_row_id", "translation").join(matched.select("sheet_row_id").distinct(), "sheet_row_id", "left_anti")
    n = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(*by)))
    joined = n(left, "ord", "item_id").join(n(rows, "row_no", "sheet_row_id"), ["path", "n"])
    return joined.select("path", "item_id", "sheet_row_id", F.when(~is_blank(F.col("translation")), F.col("translation")).alias("translation"))


def import_by_position(items: DataFrame, sheet: DataFrame) -> DataFrame:
    """Two-column sheets: ``path, n, item_id, translation, error`` of the rows that meet in order.

    Equal counts are strict: the first text that differs is an error and the
    path takes no row.  Unequal counts fill the common part by order.
    """
    w = Window.partitionBy("path")
    a = items.select("path", "item_id", "original_text", F.row_number().over(w.orderBy("ord", "item_id")).alias("n"), F.count(F.lit(1)).over(w).alias("n_items"))
    b = sheet.select("path", "source", "translation", F.row_number().over(w.orderBy("row_no", "sheet_row_id")).alias("n"), F.count(F.lit(1)).over(w).alias("n_rows"))
    both = a.join(b, ["path", "n"])
    differs = (F.col("n_items") == F.col("n_rows")) & ~trim_all(F.coalesce("original_text", F.lit(""))).eqNullSafe(trim_all(F.coalesce("source", F.lit(""))))
    marked = both.withColumn("error", F.min(F.when(differs, F.col("n"))).over(w))
    return marked.select("path", "n", "item_id", F.when(F.col("error").isNull() & ~is_blank(F.col("translation")), F.col("translation")).alias("translation"), "error")


def resolve_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """``item_id, translated, matched_by``: agents' edits by id string, else by one handle, else by trimmed source text.

    ``edits`` has ``path, id, original, translated, seq``; the last edit of a key wins.
    """
    last = lambda key: edits.select("path", key.alias("key"), "seq", "translated").where("key is not null and key <> ''").groupBy("path", "key").agg(F.max(F.struct("seq", "translated")).alias("r")).select("path", "key", F.col("r.translated").alias("t"))
    id_key = F.upper(F.regexp_replace("id", r"\s+", ""))
    one = parse_handles(F.col("id"))
    by = {"id": last(id_key), "handle": last(F.when(F.size(one) == 1, one[0])), "text": last(trim_all(F.col("original")))}
    keys: dict[str, Column] = {
        "id": F.upper(id_string(F.coalesce("cad_handles", F.array("handle")))),
        "handle": F.upper(F.trim("handle")),
        "text": trim_all(F.col("original_text")),
    }
    out = items
    for name, table in by.items():
        out = out.withColumn("key", keys[name]).join(table.withColumnRenamed("t", f"t_{name}"), ["path", "key"], "left").drop("key")
    hit = F.when(F.col("t_id").isNotNull(), "id").when(F.col("t_handle").isNotNull(), "handle").when(F.col("t_text").isNotNull(), "text")
    return out.select("item_id", F.coalesce("t_id", "t_handle", "t_text").alias("translated"), hit.alias("matched_by")).where("matched_by is not null")


def rich_sheet(merged: DataFrame) -> DataFrame:
    """Rows of a review sheet: ``path, row_no, id, source, translation, all_handles``.

    Rows without text to translate are left out; the list of handles is filled
    only where there is more than one.  ``merged`` has ``path, ord, original_text,
    translated_text, handles``.
    """
    kept = merged.where(~is_non_textual(F.col("original_text")))
    w = Window.partitionBy("path").orderBy("ord")
    return kept.select(
        "path", (F.row_number().over(w) + 1).alias("row_no"), id_string(F.col("handles")).alias("id"), F.col("original_text").alias("source"),
        F.col("translated_text").alias("translation"), F.when(F.size("handles") > 1, F.array_join("handles", ";")).otherwise("").alias("all_handles"),
    )


def plain_sheet(items: DataFrame) -> DataFrame:
    """Rows of a two-column sheet, unfiltered: ``path, row_no, source, translation``."""
    w = Window.partitionBy("path").orderBy("ord", "item_id")
    return items.select("path", (F.row_number().over(w) + 1).alias("row_no"), F.col("original_text").alias("source"), F.col("translated_text").alias("translation"))


def sheet_format(first_header: Column) -> Column:
    """``rich`` if the first header cell names an id or a handle, else ``legacy``."""
    return F.when(F.lower(trim_all(first_header)).isin("id", "handle"), "rich").otherwise("legacy")
