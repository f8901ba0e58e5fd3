"""Entities of drawings from code-value pairs, by window functions.

One pass over the pairs numbers the entities; the kinds branch from it.  Every
window is partitioned by drawing.  "Last" and "first" are by position in the
file, never by the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import is_modern_table


def _all():
    return Window.partitionBy("path").orderBy("pair_idx")


def _run():
    return _all().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_entities(pairs: DataFrame) -> DataFrame:
    """Adds ``entity`` (the number of the entity a pair belongs to), its ``kind``, and the ``section`` it is in."""
    starts = F.col("code") == 0
    numbered = pairs.select("path", "pair_idx", "code", "value", "value_line").withColumn("entity", F.sum(F.when(starts, 1).otherwise(0)).over(_run())).withColumn("kind", F.last(F.when(starts, F.upper(F.trim("value"))), ignorenulls=True).over(_run()))
    opens = (F.lag("value").over(_all()) == "SECTION") & (F.lag("code").over(_all()) == 0) & (F.col("code") == 2)
    return numbered.withColumn("section", F.last(F.when(opens, F.upper(F.trim("value"))), ignorenulls=True).over(_run())).where("entity > 0")


def _last(code: int, value: str = "value") -> Column:
    return F.max_by(F.when(F.col("code") == code, F.col(value)), F.when(F.col("code") == code, F.col("pair_idx")))


def _first(code: int, value: str = "value") -> Column:
    return F.min_by(F.when(F.col("code") == code, F.col(value)), F.when(F.col("code") == code, F.col("pair_idx")))


def _joined(condition: Column) -> Column:
    """The values of the pairs that meet a condition, one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("pair_idx", "value")))), lambda x: x["value"]), "")


def _lines(condition: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("pair_idx", "value_line")))), lambda x: x["value_line"])


_COMMON = {"handle": 5, "layer": 8, "style": 7}


def texts(entities: DataFrame) -> DataFrame:
    """TEXT: ``path, entity, section, handle, layer, style, text, text_line``; the last pair of a code counts."""
    rows = entities.where("kind = 'TEXT'").groupBy("path", "entity", "section")
    return rows.agg(*[_last(c).alias(n) for n, c in _COMMON.items()], _last(1).alias("text"), _last(1, "value_line").alias("text_line"))


def mtexts(entities: DataFrame) -> DataFrame:
    """MTEXT: the chunks of codes 3 and 1 joined in file order; a text without code 1 has no last line."""
    chunk = F.col("code").isin(1, 3)
    rows = entities.where("kind = 'MTEXT'").groupBy("path", "entity", "section")
    return rows.agg(*[_last(c).alias(n) for n, c in _COMMON.items()], F.expr("try_cast(trim(max_by(if(code = 41, value, null), if(code = 41, pair_idx, null))) as double)").alias("rect_width"), _joined(chunk).alias("text"), _lines(F.col("code") == 3).alias("code3_lines"), _last(1, "value_line").alias("last_code1_line"))


def attributes(entities: DataFrame) -> DataFrame:
    """ATTRIB of the INSERT it follows, until the end of the sequence; without tag it is dropped."""
    flat = entities.where("kind in ('INSERT', 'SEQEND', 'ATTRIB')").groupBy("path", "entity", "section", "kind")
    rows = flat.agg(*[_last(c).alias(n) for n, c in _COMMON.items()], _last(2).alias("tag"), _last(1).alias("text"), _last(1, "value_line").alias("text_line"))
    run = Window.partitionBy("path").orderBy("entity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segment = F.sum(F.when(F.col("kind").isin("INSERT", "SEQEND"), 1).otherwise(0)).over(run)
    owner = F.max(F.when(F.col("kind") == "INSERT", F.col("handle"))).over(Window.partitionBy("path", "segment"))
    with_owner = rows.withColumn("segment", segment).withColumn("insert_handle", F.coalesce(owner, F.lit("")))
    return with_owner.where("kind = 'ATTRIB' and tag <> ''").select("path", "entity", "section", "insert_handle", "handle", "tag", "layer", "style", "text", "text_line", F.concat("insert_handle", F.lit("::"), "tag").alias("composite_key"))


def versions(pairs: DataFrame) -> DataFrame:
    """``path, version``: the value after ``$ACADVER``."""
    name = (F.col("code") == 9) & (F.trim("value") == "$ACADVER")
    rows = pairs.withColumn("named", F.lag(name).over(_all())).where("named and code = 1")
    return rows.groupBy("path").agg(F.min_by(F.trim("value"), "pair_idx").alias("version"))


def cells(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells of tables: ``path, entity, table_handle, layer, row, column, cell_type, text, text_line, rest_lines``.

    Newer drawings start a cell at each code 301 (text 302, type 171), older ones
    at each 171 (text of codes 1 and 3).  Cells beyond the declared rows, and
    tables with no row or column, are left out.  ``rest_lines`` are further lines
    that hold a part of the text.
    """
    rows = entities.where("kind = 'ACAD_TABLE'").join(versions(pairs), "path", "left").withColumn("modern", is_modern_table(F.col("version")))
    shape = rows.groupBy("path", "entity", "modern").agg(F.trim(_first(5)).alias("table_handle"), F.trim(_first(8)).alias("layer"), F.expr("try_cast(trim(min_by(if(code = 91, value, null), if(code = 91, pair_idx, null))) as int)").alias("rows"), F.expr("try_cast(trim(min_by(if(code = 92, value, null), if(code = 92, pair_idx, null))) as int)").alias("columns"))
    start = F.when(F.col("modern"), F.col("code") == 301).otherwise(F.col("code") == 171)
    run = Window.partitionBy("path", "entity").orderBy("pair_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("cell", F.sum(F.when(start, 1).otherwise(0)).over(run) - 1).where("cell >= 0")
    old_text = F.col("code").isin(1, 3)
    parts = inside.groupBy("path", "entity", "cell").agg(
        F.expr("try_cast(trim(max_by(if(code = 171, value, null), if(code = 171, pair_idx, null))) as int)").alias("cell_type"),
        F.trim(_last(302)).alias("new_text"), _last(302, "value_line").alias("new_line"),
        _joined(old_text).alias("old_text"), _first(1, "value_line").alias("old_line"), _lines(F.col("code") == 3).alias("rest_lines"),
    )
    out = parts.join(shape, ["path", "entity"]).where("rows > 0 and columns > 0").withColumn("row", F.expr("cast(cell div columns as int)")).withColumn("column", (F.col("cell") % F.col("columns")).cast("int")).where("row < rows")
    pick = lambda new, old: F.when(F.col("modern"), F.col(new)).otherwise(F.col(old))
    return out.select("path", "entity", "table_handle", "layer", "row", "column", "cell_type", F.coalesce(pick("new_text", "old_text"), F.lit("")).alias("text"), pick("new_line", "old_line").alias("text_line"), F.when(F.col("modern"), F.array().cast("array<int>")).otherwise(F.col("rest_lines")).alias("rest_lines"))


def leaders(entities: DataFrame) -> DataFrame:
    """Leaders: text, style and width count only between codes 300 and 301; the last of them wins."""
    run = Window.partitionBy("path", "entity").orderBy("pair_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = entities.where("kind in ('MULTILEADER', 'MLEADER')").withColumn("context", F.coalesce(F.last(F.when(F.col("code").isin(300, 301), F.col("code")), ignorenulls=True).over(run) == 300, F.lit(False)))
    within = lambda code, value="value": F.max_by(F.when(F.col("context") & (F.col("code") == code), F.col(value)), F.when(F.col("context") & (F.col("code") == code), F.col("pair_idx")))
    return rows.groupBy("path", "entity").agg(
        F.trim(_first(5)).alias("handle"), F.trim(_first(8)).alias("layer"), F.expr("try_cast(trim(min_by(if(code = 172, value, null), if(code = 172, pair_idx, null))) as int)").alias("content_type"),
        F.coalesce(F.trim(within(304)), F.lit("")).alias("text"), F.trim(within(340)).alias("style_handle"), F.expr("try_cast(trim(max_by(if(context and code = 41, value, null), if(context and code = 41, pair_idx, null))) as double)").alias("boundary_width"), within(304, "value_line").alias("text_line"),
    )


def layer_states(entities: DataFrame) -> DataFrame:
    """``path, name, frozen, locked, off`` of the LAYER table: bits 1 and 4 of code 70, a negative colour; the last of a name wins."""
    rows = entities.groupBy("path", "entity", "kind").agg(F.trim(_last(2)).alias("name"), F.expr("try_cast(trim(max_by(if(code = 70, value, null), if(code = 70, pair_idx, null))) as int)").alias("flags"), F.expr("try_cast(trim(max_by(if(code = 62, value, null), if(code = 62, pair_idx, null))) as int)").alias("colour"))
    run = Window.partitionBy("path").orderBy("entity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.last(F.when(F.col("kind") == "TABLE", F.upper("name") == "LAYER").when(F.col("kind") == "ENDTAB", F.lit(False)), ignorenulls=True).over(run)
    layers = rows.withColumn("inside", inside).where("inside and kind = 'LAYER' and name <> ''")
    bit = lambda n: F.coalesce(F.col("flags").bitwiseAND(F.lit(n)) != 0, F.lit(False))
    state = F.max_by(F.struct("name", bit(1).alias("frozen"), bit(4).alias("locked"), F.coalesce(F.col("colour") < 0, F.lit(False)).alias("off")), "entity").alias("s")
    return layers.groupBy("path", F.upper("name").alias("key")).agg(state).select("path", "s.name", "s.frozen", "s.locked", "s.off")


def nearest_before(pairs: DataFrame, code: int, within: int = 25) -> DataFrame:
    """Adds ``near_value`` and ``near_line``: the nearest pair of a code at or before each pair, at most ``within`` pairs away."""
    w = _all().rowsBetween(-within, Window.currentRow)
    hit = F.when(F.col("code") == code, F.struct("value", "value_line"))
    near = F.last(hit, ignorenulls=True).over(w)
    return pairs.withColumn("near_value", near["value"]).withColumn("near_line", near["value_line"])
