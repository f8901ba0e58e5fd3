"""Queries on whole drawings: lines, pairs, entities, codecs, write-back.

The data folder holds items, not files, so the drawings are composed from the
items first; what comes back is checked against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import mtext as C
from glyphlake.operators import entities as N
from glyphlake.operators import writeback as W
from glyphlake.operators.extract import ExtractConfig, extract_items
from glyphlake.plans.texts import ITEMS_SQL, items
from glyphlake.runtime import table
from glyphlake.sources.dxf import pairs_of, structure_check

_COLUMNS = ("path", "ord", "handle", "entity_type", "raw_original_text", "layer_name")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.compose(items(spark, sf_dir, *_COLUMNS))


def drawing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_check(_lines(spark, sf_dir))


def group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(_lines(spark, sf_dir)).groupBy("path", "code").agg(F.count(F.lit(1)).alias("pairs"))


def entity_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.texts(N.with_entities(pairs_of(_lines(spark, sf_dir)))).select("path", "section", "handle", "layer", "text")


def mtext_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.mtexts(N.with_entities(pairs_of(_lines(spark, sf_dir)))).select("path", "handle", "layer", "rect_width", "text", F.size("code3_lines").alias("chunks"))


def insert_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute items as children of inserts, composed as pairs and read back."""
    it = items(spark, sf_dir, "path", "handle", "entity_type", "attribute_tag", "original_text").where("entity_type = 'Attribute' and attribute_tag is not null and original_text is not null")
    owner = F.regexp_replace("handle", r"::.*$", "")
    parts = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in ((0, F.lit("INSERT")), (5, owner), (0, F.lit("ATTRIB")), (5, F.lit("A1")), (2, F.col("attribute_tag")), (1, F.col("original_text")), (0, F.lit("SEQEND")))])
    pairs = it.select("path", F.col("item_id"), F.posexplode(parts).alias("pos", "p")).select("path", (F.col("item_id") * 10 + F.col("pos")).alias("pair_idx"), "p.code", "p.value", F.lit(0).alias("value_line"))
    return N.attributes(N.with_entities(pairs)).select("path", "insert_handle", "tag", "text")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables composed from the table items, in the newer format; cells outside the declared rows vanish."""
    it = items(spark, sf_dir, "path", "handle", "entity_type", "table_row", "table_column", "original_text").where("entity_type = 'TableCell' and original_text is not null")
    owner = F.regexp_replace("handle", r"::.*$", "")
    cell = it.select("path", owner.alias("h"), "table_row", "table_column", F.trim(F.regexp_replace("original_text", r"[\r\n]+", " ")).alias("t"))
    # Every table has one column here: its cells in their order are its rows, and one row too few is declared.
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("path", "h").orderBy("table_row", "table_column", "t"))
    rows = cell.withColumn("n", n).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("path", "h")))
    head = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in ((0, F.lit("ACAD_TABLE")), (5, F.col("h")), (91, (F.greatest(F.col("total") - 1, F.lit(1))).cast("string")), (92, F.lit("1")))])
    body = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in ((301, F.lit("CELL_VALUE")), (171, F.lit("1")), (302, F.col("t")))])
    # The order of pairs needs no global numbering: tables of a path by handle, cells by number.
    parts = F.when(F.col("n") == 1, F.concat(head, body)).otherwise(body)
    placed = rows.select("path", "h", "n", F.posexplode(parts).alias("pos", "p"))
    idx = F.row_number().over(Window.partitionBy("path").orderBy("h", "n", "pos"))
    pairs = placed.select("path", idx.alias("pair_idx"), "p.code", "p.value", F.lit(0).alias("value_line"))
    return N.cells(N.with_entities(pairs), pairs).select("path", "table_handle", "row", "column", "cell_type", "text")


def leader_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders composed with a text before, inside and after their context; only the last inside counts."""
    it = items(spark, sf_dir, "path", "handle", "entity_type", "original_text").where("entity_type = 'MLeader' and original_text is not null")
    text = F.trim(F.regexp_replace("original_text", r"[\r\n]+", " "))
    parts = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in ((0, F.lit("MULTILEADER")), (5, F.regexp_replace("handle", "::CTX$", "")), (172, F.lit("2")), (304, F.lit("before")), (300, F.lit("CONTEXT_DATA{")), (304, F.lit("first")), (304, text), (41, F.lit("50.5")), (301, F.lit("}")), (304, F.lit("after")))])
    pairs = it.select("path", "item_id", F.posexplode(parts).alias("pos", "p")).select("path", (F.col("item_id") * 16 + F.col("pos")).alias("pair_idx"), "p.code", "p.value", F.lit(0).alias("value_line"))
    return N.leaders(N.with_entities(pairs)).select("path", "handle", "content_type", "text", "boundary_width")


def layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer table composed from the layers and read back."""
    rows = table(spark, sf_dir, "layers").groupBy("path", F.upper("name").alias("key")).agg(F.max(F.struct("name", "frozen", "locked", "off")).alias("s")).select("path", "key", "s.*")
    flags = (F.coalesce("frozen", F.lit(False)).cast("int") + 4 * F.coalesce("locked", F.lit(False)).cast("int")).cast("string")
    colour = F.when(F.coalesce("off", F.lit(False)), "-7").otherwise("7")
    parts = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in ((0, F.lit("LAYER")), (2, F.col("name")), (70, flags), (62, colour))])
    from pyspark.sql import Window

    body = rows.select("path", F.col("key").alias("k"), F.posexplode(parts).alias("pos", "p"))
    head = rows.select("path").distinct().select("path", F.lit("").alias("k"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(v).alias("value")) for c, v in ((0, "TABLE"), (2, "LAYER"))])).alias("pos", "p"))
    placed = head.unionByName(body)
    pairs = placed.select("path", F.row_number().over(Window.partitionBy("path").orderBy("k", "pos")).alias("pair_idx"), "p.code", "p.value", F.lit(0).alias("value_line"))
    return N.layer_states(N.with_entities(pairs))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.compose_kinds(items(spark, sf_dir, *_COLUMNS))


def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_items(pairs_of(_kinds(spark, sf_dir)), ExtractConfig())
    return found.groupBy("path", "entity_type", "filter_reason").agg(F.count(F.lit(1)).alias("items"))


def extract_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph texts read apart: the handles of the entity and the number of the paragraph."""
    found = extract_items(pairs_of(_lines(spark, sf_dir)), ExtractConfig(mtext_whole=False, mtext_paragraphs=True))
    return found.where("entity_type = 'MText'").select("path", "handle", "raw_original_text")


def mtext_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "raw_original_text").select("item_id", C.strip_codes_udf(F.col("raw_original_text")).alias("s")).select("item_id", "s.text", F.size("s.codes").alias("codes"))


def mtext_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose codes were taken out and put back, and whether they are the same. Escaped characters and literal braces come back escaped."""
    stripped = C.strip_codes_udf(F.col("raw_original_text"))
    rows = items(spark, sf_dir, "raw_original_text").where("raw_original_text <> ''")
    return rows.select("item_id", (F.replace(C.restore_codes_udf(stripped), F.lit("\\P"), F.lit("\n")) == F.replace("raw_original_text", F.lit("\\P"), F.lit("\n"))).alias("same"))


def mtext_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir, "raw_original_text", "translated_text").where("translated_text is not null")
    return rows.select("item_id", C.rebuild_udf(F.col("raw_original_text"), F.col("translated_text"), F.lit(40.0)).alias("rebuilt"))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, *_COLUMNS).where("entity_type = 'Text' and raw_original_text is not null").withColumn("translated_text", F.concat(F.lit("T:"), F.col("handle")))


def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the drawings after each got a translation: read again from the new lines."""
    lines, _ = W.write_back(_lines(spark, sf_dir), _translated(spark, sf_dir))
    return N.texts(N.with_entities(pairs_of(lines))).select("path", "handle", "text")


def write_back_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.summary(W.write_back(_lines(spark, sf_dir), _translated(spark, sf_dir))[1])


def _all_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, *_COLUMNS).where("raw_original_text is not null").withColumn("translated_text", F.concat(F.lit("T:"), F.col("handle")))


def write_back_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``write_back`` for all five kinds, each in an entity of its own kind: every place a text can stand, read again from the new lines."""
    lines, _ = W.write_back(_kinds(spark, sf_dir), _all_translated(spark, sf_dir))
    return W.targets(pairs_of(lines)).select("path", F.col("kind").alias("entity_type"), "key", F.col("raw").alias("text"))


def write_back_kinds_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.summary(W.write_back(_kinds(spark, sf_dir), _all_translated(spark, sf_dir))[1])


def layout_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir, *_COLUMNS).where("entity_type in ('Text', 'MText') and raw_original_text is not null")
    before = it.select("path", "entity_type", "handle", F.col("raw_original_text").alias("text"))
    after = before.withColumn("text", F.concat("text", "text"))
    return W.layout(pairs_of(_lines(spark, sf_dir)), before, after).select("path", "entity_type", "key", "scale", "height")


_ONCE = f"WITH {ITEMS_SQL}"
_LINE = "regexp_replace(translate(raw_original_text, chr(13) || chr(10) || chr(9), '   '), '[\\x{00}-\\x{1F}]', '', 'g')"
_FLAT = "translate(raw_original_text, chr(13) || chr(10) || chr(9), '   ')"
_LAYER = "CASE WHEN coalesce(layer_name, '') <> '' THEN layer_name ELSE '0' END"
_CHUNKS = f"greatest(1, ceil(length({_FLAT}) / 250.0))::BIGINT"
_GUARD = f"regexp_full_match({_LINE}, '[\\t-\\r\\x{{85}}\\p{{Z}}]*[+-]?[0-9]+[\\t-\\r\\x{{85}}\\p{{Z}}]*')"
_GUARD_ANY = f"CASE WHEN entity_type = 'MText' THEN {_GUARD.replace(_LINE, _FLAT)} ELSE {_GUARD} END"

QUERIES = {
    "drawing_lines": drawing_lines,
    "group_pairs": group_pairs,
    "entity_assembly": entity_assembly,
    "mtext_assembly": mtext_assembly,
    "insert_attributes": insert_attributes,
    "table_cells": table_cells,
    "leader_context": leader_context,
    "layer_table": layer_table,
    "extract_items": extract,
    "extract_paragraphs": extract_paragraphs,
    "mtext_strip": mtext_strip,
    "mtext_round_trip": mtext_round_trip,
    "mtext_rebuild": mtext_rebuild,
    "write_back": write_back,
    "write_back_log": write_back_log,
    "write_back_kinds": write_back_kinds,
    "write_back_kinds_log": write_back_kinds_log,
    "layout_adjust": layout_adjust,
}
ORACLE = {
    "drawing_lines": f"{_ONCE} SELECT path, 8 + coalesce(sum(CASE WHEN raw_original_text IS NULL THEN 0 WHEN entity_type = 'MText' THEN 10 + 2 * {_CHUNKS} ELSE 10 END), 0)::BIGINT AS lines, true AS even, 0::BIGINT AS bad_codes FROM items_once GROUP BY path",
    "group_pairs": f"{_ONCE}, k AS (SELECT * FROM items_once WHERE raw_original_text IS NOT NULL), n AS (SELECT path, count(*) AS n, count(*) FILTER (entity_type = 'MText') AS m, coalesce(sum(CASE WHEN entity_type = 'MText' THEN {_CHUNKS} - 1 END), 0)::BIGINT AS c3 FROM k GROUP BY path), p AS (SELECT path, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(c3, 0) AS c3 FROM (SELECT DISTINCT path FROM items_once) LEFT JOIN n USING (path)) SELECT * FROM (SELECT path, unnest([0, 2, 5, 8, 40, 1, 41, 3]) AS code, unnest([n + 3, 1, n, n, n, n, m, c3]) AS pairs FROM p) WHERE pairs > 0",
    "entity_assembly": f"{_ONCE} SELECT path, 'ENTITIES' AS section, handle, {_LAYER} AS layer, {_LINE} AS text FROM items_once WHERE entity_type <> 'MText' AND raw_original_text IS NOT NULL",
    "mtext_assembly": f"{_ONCE} SELECT path, handle, {_LAYER} AS layer, 50.0::DOUBLE AS rect_width, {_FLAT} AS text, ({_CHUNKS} - 1)::INT AS chunks FROM items_once WHERE entity_type = 'MText' AND raw_original_text IS NOT NULL",
    "insert_attributes": f"{_ONCE} SELECT path, regexp_replace(handle, '::.*$', '') AS insert_handle, attribute_tag AS tag, original_text AS text FROM items_once WHERE entity_type = 'Attribute' AND attribute_tag <> '' AND original_text IS NOT NULL",
    "table_cells": f"{_ONCE}, c AS (SELECT path, regexp_replace(handle, '::.*$', '') AS h, table_row, table_column, trim(regexp_replace(original_text, '[\\r\\n]+', ' ', 'g'), ' ') AS t FROM items_once WHERE entity_type = 'TableCell' AND original_text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY path, h ORDER BY table_row, table_column, t) AS n, count(*) OVER (PARTITION BY path, h) AS total FROM c) SELECT path, h AS table_handle, (n - 1)::INT AS row, 0::INT AS column, 1::INT AS cell_type, t AS text FROM n WHERE n <= greatest(total - 1, 1)",
    "leader_context": f"{_ONCE} SELECT path, regexp_replace(handle, '::CTX$', '') AS handle, 2::INT AS content_type, trim(regexp_replace(original_text, '[\\r\\n]+', ' ', 'g'), ' ') AS text, 50.5::DOUBLE AS boundary_width FROM items_once WHERE entity_type = 'MLeader' AND original_text IS NOT NULL",
    "layer_table": "SELECT path, s.name AS name, coalesce(s.frozen, false) AS frozen, coalesce(s.locked, false) AS locked, coalesce(s.off, false) AS off FROM (SELECT path, upper(name) AS key, max({'name': name, 'frozen': frozen, 'locked': locked, 'off': off}) AS s FROM layers GROUP BY 1, 2)",
    "extract_paragraphs": f"{_ONCE}, p AS (SELECT path, handle, unnest(string_split({_FLAT}, '\\P')) AS part, generate_subscripts(string_split({_FLAT}, '\\P'), 1) AS pos FROM items_once WHERE entity_type = 'MText' AND raw_original_text IS NOT NULL) SELECT path, handle || ':P' || (row_number() OVER (PARTITION BY path, handle ORDER BY pos) - 1) AS handle, part AS raw_original_text FROM p WHERE NOT regexp_full_match(part, '[\\t-\\r\\x{{85}}\\p{{Z}}]*')",
    "write_back": f"{_ONCE} SELECT path, handle, CASE WHEN entity_type = 'Text' AND NOT {_GUARD} THEN 'T:' || handle ELSE {_LINE} END AS text FROM items_once WHERE entity_type <> 'MText' AND raw_original_text IS NOT NULL",
    "write_back_log": f"{_ONCE} SELECT path, count(*) FILTER (NOT {_GUARD}) AS ok, count(*) FILTER ({_GUARD}) AS skipped, 0::BIGINT AS warnings FROM items_once WHERE entity_type = 'Text' AND raw_original_text IS NOT NULL GROUP BY path",
    "write_back_kinds_log": f"{_ONCE} SELECT path, count(*) FILTER (NOT {_GUARD_ANY}) AS ok, count(*) FILTER ({_GUARD_ANY}) AS skipped, 0::BIGINT AS warnings FROM items_once WHERE raw_original_text IS NOT NULL GROUP BY path",
}
