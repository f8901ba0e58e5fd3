"""Items of drawings: the five kinds of entities in one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.predicates import CleanConfig, filter_reason, is_blank, trim_all
from glyphlake.functions.text import strip_for_translation
from glyphlake.operators import entities as N
from glyphlake.operators.layers import visible_items
from glyphlake.runtime import materialize


@dataclass(frozen=True)
class ExtractConfig:
    """What is read from drawings."""

    attributes: bool = True
    tables: bool = True
    leaders: bool = True
    mtext_whole: bool = True
    mtext_paragraphs: bool = False
    frozen_layers: bool = False
    locked_layers: bool = False
    off_layers: bool = False
    filter_leader_layers: bool = False
    drop_skipped: bool = False
    clean: CleanConfig = field(default_factory=CleanConfig)


def _kind(df: DataFrame, rank: int, kind: str, handle: Column, raw: Column, layer: str, place: Column | tuple[Column, ...], **more: Column) -> DataFrame:
    """The rows of one kind; ``place`` orders them: the entity, and up to two places inside it."""
    extra = {"attribute_tag": F.lit(None).cast("string"), "table_row": F.lit(-1), "table_column": F.lit(-1)} | more
    within = [*(place if isinstance(place, tuple) else (place,)), F.lit(0), F.lit(0)][:3]
    order = F.struct(*[p.cast("bigint").alias(f"p{i}") for i, p in enumerate(within)])
    return df.select("path", F.lit(rank).alias("rank"), order.alias("place"), handle.alias("handle"), F.lit(kind).alias("entity_type"), raw.alias("raw_original_text"), F.col(layer).alias("layer_name"), *[c.alias(n) for n, c in extra.items()])


def _or_line(handle: str, line: str) -> Column:
    return F.when(F.coalesce(F.col(handle), F.lit("")) != "", F.col(handle)).otherwise(F.concat(F.lit("L"), F.col(line)))


def extract_items(pairs: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``path, ord, handle, entity_type, raw_original_text, original_text, layer_name, attribute_tag, table_row, table_column, cleaned_text, status, filter_reason``.

    Kinds follow in the order text, paragraph text, attribute, cell, leader, and
    each in the order of the file.  Blank texts are left out.  Rows that need no
    translation are marked, not dropped, unless ``drop_skipped`` is set.
    """
    # One scan and one window pass: the kinds, the layers and the version branch from rows written once.
    found = materialize(N.with_entities(pairs))
    pairs = found
    kinds = [_kind(N.texts(found), 0, "Text", _or_line("handle", "text_line"), F.col("text"), "layer", F.col("entity"))]
    mtext = N.mtexts(found).withColumn("line", F.coalesce("last_code1_line", F.element_at(F.concat("code3_lines", F.array(F.lit(0))), 1)))
    if config.mtext_whole:
        kinds.append(_kind(mtext, 1, "MText", _or_line("handle", "line"), F.col("text"), "layer", F.col("entity")))
    elif config.mtext_paragraphs:
        kinds.append(paragraphs(mtext))
    if config.attributes:
        kinds.append(_kind(N.attributes(found), 2, "Attribute", F.col("composite_key"), F.col("text"), "layer", F.col("entity"), attribute_tag=F.col("tag")))
    if config.tables:
        c = N.cells(found, pairs).where("cell_type = 1")
        handle = F.concat("table_handle", F.lit("::R"), F.col("row").cast("string"), F.lit("::C"), F.col("column").cast("string"))
        kinds.append(_kind(c, 3, "TableCell", handle, F.col("text"), "layer", (F.col("entity"), F.col("row"), F.col("column")), table_row=F.col("row"), table_column=F.col("column")))
    if config.leaders:
        kinds.append(_kind(N.leaders(found).where("content_type = 2"), 4, "MLeader", F.concat("handle", F.lit("::CTX")), F.col("text"), "layer", F.col("entity")))
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    rows = visible_items(rows.where(~is_blank(F.col("raw_original_text"))), N.layer_states(found), config.frozen_layers, config.locked_layers, config.off_layers, config.filter_leader_layers)
    w = Window.partitionBy("path").orderBy("rank", "place", "handle")
    plain = F.when(F.col("entity_type") == "Text", F.col("raw_original_text")).otherwise(strip_for_translation(F.col("raw_original_text")))
    named = rows.withColumn("ord", F.row_number().over(w) - 1).withColumn("original_text", plain)
    reason = filter_reason(F.col("original_text"), config.clean)
    out = named.withColumn("cleaned_text", trim_all(F.col("original_text"))).withColumn("filter_reason", reason).withColumn("status", F.when(F.col("filter_reason").isNotNull(), "skipped")).drop("rank", "place")
    return out.where("status is null") if config.drop_skipped else out


def paragraphs(mtext: DataFrame) -> DataFrame:
    """Paragraph texts apart: handle ``{h}:P{n}``, numbered over those that are not blank."""
    parts = mtext.select("path", "entity", "handle", "layer", "line", F.posexplode(F.split("text", r"\\P")).alias("pos", "part")).where(~is_blank(F.col("part")))
    n = F.row_number().over(Window.partitionBy("path", "entity").orderBy("pos")) - 1
    numbered = parts.withColumn("n", n).withColumn("owner", _or_line("handle", "line"))
    return _kind(numbered, 1, "MText", F.concat("owner", F.lit(":P"), F.col("n").cast("string")), F.col("part"), "layer", (F.col("entity"), F.col("n")))


def merge_paragraphs(items: DataFrame) -> DataFrame:
    """Paragraph rows put back together by their entity: ``path, handle, entity_type, ord, translated_text`` with paragraph marks, and ``paragraphs``, the translations by number."""
    rows = items.where(F.col("handle").rlike(r":P[0-9]+$")).select("path", F.col("handle").alias("part"), "original_text", F.col("translated_text").alias("given"), F.col("ord").alias("at"))
    n = F.regexp_extract("part", r":P([0-9]+)$", 1).cast("int")
    owner = F.regexp_replace("part", r":P[0-9]+$", "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.coalesce("given", "original_text").alias("t")))), lambda x: x["t"])
    # Of several rows for a paragraph the last by ``ord`` counts.
    given = F.array_sort(F.collect_list(F.when(~is_blank(F.col("given")), F.struct(n.alias("n"), "at", F.col("given").alias("t")))))
    last = F.filter(given, lambda x, i: F.coalesce(F.try_element_at(given, i + 2)["n"] != x["n"], F.lit(True)))
    numbered = F.map_from_entries(F.transform(last, lambda x: F.struct(x["n"], x["t"])))
    return rows.groupBy("path", owner.alias("handle")).agg(F.array_join(parts, "\n").alias("translated_text"), F.min("at").alias("ord"), numbered.alias("paragraphs")).withColumn("entity_type", F.lit("MText"))
