"""Queries on single texts: predicates, the cleaning cascade, string functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import predicates as P
from glyphlake.functions import text as T
from glyphlake.operators.deliveries import first_delivery
from glyphlake.runtime import table

ITEM_COLUMNS = ("item_id", "path", "project_code", "ord", "handle", "entity_type", "raw_original_text", "original_text", "source_lang", "translated_text", "layer_name", "cad_handles", "table_row", "table_column", "cleaned_text", "status", "ai_filter_decision", "loaded_at")


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The items, once each; only the named columns are read."""
    wanted = ["item_id", *[c for c in columns if c not in ("item_id", "loaded_at")], "loaded_at"]
    return first_delivery(table(spark, sf_dir, "items").select(*wanted), "item_id", "loaded_at")


#: The same in SQL; values of repeated deliveries are equal, so any row of the earliest time serves.
ITEMS_SQL = "items_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loaded_at) AS delivery FROM items) WHERE delivery = 1)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TRIM = "regexp_replace(original_text, " + _quote(rf"^{P.SPACE}+|{P.SPACE}+$") + ", '', 'g')"
_BLANK = f"(original_text IS NULL OR regexp_full_match(original_text, {_quote(P.SPACE + '*')}))"
_TAG = f"(regexp_matches({_TRIM}, '[#@]') OR (regexp_matches({_TRIM}, '\\p{{Lu}}') AND regexp_matches({_TRIM}, '\\p{{Nd}}') AND NOT regexp_matches({_TRIM}, '\\p{{Ll}}')))"
SQL_PREDICATES = {
    "is_number": f"(NOT {_BLANK} AND regexp_matches({_TRIM}, {_quote(P.NUMBER_PATTERN)}))",
    "is_code": f"(NOT {_BLANK} AND regexp_matches({_TRIM}, {_quote(P.CODE_PATTERN)}))",
    "is_symbol": f"(NOT {_BLANK} AND regexp_matches(original_text, {_quote(P.SYMBOL_PATTERN)}))",
    "is_tag": f"(NOT {_BLANK} AND {_TAG})",
    "is_non_textual": f"({_BLANK} OR NOT regexp_matches(original_text, {_quote(P.TEXTUAL)}))",
}
_REASON = f"""CASE WHEN {_BLANK} THEN 'Empty' WHEN {SQL_PREDICATES['is_symbol']} THEN 'Symbol' WHEN {SQL_PREDICATES['is_number']} THEN 'Number'
  WHEN {SQL_PREDICATES['is_code']} THEN 'Code' WHEN {SQL_PREDICATES['is_tag']} THEN 'EngineeringTag'
  WHEN regexp_matches({_TRIM}, {_quote(P.LANGUAGE_RANGES['zh'])}) THEN 'TargetLang(zh)' END"""


def _predicate(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return items(spark, sf_dir, "original_text").select("item_id", getattr(P, name)(F.col("original_text")).alias(name))

    return query


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("original_text")
    return items(spark, sf_dir, "original_text").select("item_id", P.trim_all(text).alias("cleaned"), P.filter_reason(text).alias("reason"), P.filter_reason(text).isNotNull().alias("filtered"))


def clean_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "original_text", "entity_type").withColumn("reason", P.filter_reason(F.col("original_text"))).groupBy("entity_type", "reason").agg(F.count(F.lit(1)).alias("items"))


def matches_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("original_text")
    return items(spark, sf_dir, "original_text").select("item_id", *[P.matches_language(text, x).alias(x) for x in ("zh", "en", "ja", "ko", "fr")])


def non_source_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = P.CleanConfig(source_lang="en", target_lang="ja", filter_non_source_lang=True, skip_patterns=("^NOTE:", "^(Level|Width)\\s*[:=]", "("))
    return items(spark, sf_dir, "original_text").select("item_id", P.filter_reason(F.col("original_text"), config).alias("reason"))


def _function(fn: Callable[[Column], Column], source: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return items(spark, sf_dir, source).select("item_id", fn(F.col(source)).alias(name))

    return query


def chunks_250(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first_delivery(table(spark, sf_dir, "documents").select("doc_id", "text", "loaded_at"), "doc_id", "loaded_at")
    return docs.where("text is not null").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", "chunk.code", "chunk.text")


def layout_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overflow of the translations against the width of the originals, at a text height of one."""
    it = items(spark, sf_dir, "original_text", "translated_text").where("trim(translated_text) <> ''")
    wide, bound = T.visual_width(F.col("translated_text")), T.visual_width(F.col("original_text"))
    return it.select("item_id", wide.alias("width"), bound.alias("bound"), F.round(T.layout_scale(wide, bound), 6).alias("scale"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of the providers' languages; rows without a code are not supported by the provider."""
    rows = [(code, primary, p, x) for code, primary, *codes in T.PROVIDER_CODES for p, x in zip(T.PROVIDERS, codes) if x]
    return spark.createDataFrame(rows, "code string, is_primary boolean, provider string, provider_code string")


def drawing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the drawings as each provider writes them."""
    drawings = table(spark, sf_dir, "drawings").select("path", T.normalize_language(F.col("source_lang")).alias("lang")).distinct()
    dim = languages(spark, sf_dir).select(F.lower("code").alias("lang"), "provider", "provider_code")
    return drawings.join(F.broadcast(dim), "lang").select("path", "provider", "provider_code")


def table_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "drawings").select("path", "acad_version", T.is_modern_table(F.col("acad_version")).alias("modern")).distinct()


def handle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir, "handle", "cad_handles", "table_row", "table_column")
    return it.select("item_id", T.id_string(F.col("cad_handles")).alias("id_string"), (F.size(F.coalesce("cad_handles", F.array().cast("array<string>"))) > 1).alias("is_merged"), T.cell_reference(F.col("table_row"), F.col("table_column")).alias("table_cell_ref"), T.owner_handle(F.col("handle")).alias("owner"))


def ai_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions read back from replies that wrap the array in prose and fences."""
    it = items(spark, sf_dir, "ai_filter_decision").where("ai_filter_decision is not null")
    reply = F.concat(F.lit("Here you are:\n```json\n[{\"index\": 0, \"decision\": \""), F.lower("ai_filter_decision"), F.lit("\", \"reason\": \"r\"}, {\"index\": -1}]\n```"))
    return it.select("item_id", F.explode(P.parse_ai_decisions(reply)).alias("d")).select("item_id", "d.index", "d.decision", "d.reason")


_STRIP = """trim_all(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  raw_original_text, '(?i)\\{\\\\F[^;]*;([^}]*)\\}', '\\1', 'g'), '\\\\S[^;]*;', '', 'g'), '\\\\[WHATQCSplLoOkK][^;]*;', '', 'g'), '\\\\[Pp]', chr(10), 'g'), '\\\\~', chr(160), 'g'), '\\\\[nN]', '', 'g'), '[{}]', '', 'g'),
  '\\\\', chr(1)), '\\;', ';'), chr(1), '\\'))"""
_STRIP = _STRIP.replace("trim_all(", "regexp_replace(")[:-1] + ", " + _quote(rf"^{P.SPACE}+|{P.SPACE}+$") + ", '', 'g')"
_WIDTH = "(length({0}) - length(regexp_replace({0}, '[\\t-\\r\\x{{85}}\\p{{Z}}]', '', 'g'))) * 35 + (length(regexp_replace({0}, '[\\t-\\r\\x{{85}}\\p{{Z}}]', '', 'g')) - length(regexp_replace({0}, '[\\x{{00}}-\\x{{08}}\\x{{0E}}-\\x{{1F}}!-\\x{{7F}}]|[\\t-\\r\\x{{85}}\\p{{Z}}]', '', 'g'))) * 55 + length(regexp_replace({0}, '[\\x{{00}}-\\x{{08}}\\x{{0E}}-\\x{{1F}}!-\\x{{7F}}]|[\\t-\\r\\x{{85}}\\p{{Z}}]', '', 'g')) * 100"


def _from_items(select: str, where: str = "") -> str:
    return f"WITH {ITEMS_SQL} SELECT {select} FROM items_once {where}"


_SCRIPT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(c, {_quote(p)}) THEN {_quote(n)}" for n, p in T.SCRIPT_RANGES.items()) + " ELSE 'Latin' END"
_UNION = "[" + "".join(p[1:-1] for p in T.SCRIPT_RANGES.values()) + "]"
_SANITIZE = "regexp_replace(translate({0}, chr(13) || chr(10) || chr(9), '   '), '[\\x{{00}}-\\x{{1F}}]', '', 'g')"
_ESCAPE = "regexp_replace(replace(replace(replace(replace(replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\P'), chr(9), ' '), '[\\x{{00}}-\\x{{1F}}]', '', 'g')"

QUERIES = {
    **{name: _predicate(name) for name in SQL_PREDICATES},
    "clean_texts": clean_texts,
    "clean_reason_counts": clean_reason_counts,
    "matches_language": matches_language,
    "non_source_language": non_source_language,
    "trim_unicode": _function(P.trim_all, "original_text", "trimmed"),
    "sanitize_line": _function(T.sanitize_line, "original_text", "line"),
    "strip_for_translation": _function(T.strip_for_translation, "raw_original_text", "plain"),
    "escape_and_normalize": _function(T.escape_and_normalize, "original_text", "escaped"),
    "visual_width": _function(T.visual_width, "original_text", "width"),
    "detect_script": _function(T.detect_script, "original_text", "script"),
    "encode_unicode": _function(T.encode_unicode, "original_text", "encoded"),
    "language_codes": _function(T.normalize_language, "source_lang", "code"),
    "text_for_translation": lambda spark, d: items(spark, d, "raw_original_text", "original_text").select("item_id", T.text_for_translation(F.col("raw_original_text"), F.col("original_text")).alias("text")),
    "unicode_style": lambda spark, d: items(spark, d, "original_text", "layer_name").select("item_id", T.unicode_style(F.col("original_text"), F.col("layer_name")).alias("style")),
    "chunks_250": chunks_250,
    "layout_scale": layout_scale,
    "languages": languages,
    "drawing_languages": drawing_languages,
    "table_format": table_format,
    "handle_parts": handle_parts,
    "ai_response_parse": ai_response_parse,
}
_LANGUAGE_VALUES = ", ".join(f"({_quote(code)}, {str(primary).lower()}, {_quote(p)}, {_quote(x)})" for code, primary, *codes in T.PROVIDER_CODES for p, x in zip(T.PROVIDERS, codes) if x)
_CODE_SQL = "CASE WHEN split_part(lower(trim({0})), '-', 1) = 'jp' THEN 'ja' ELSE split_part(lower(trim({0})), '-', 1) END"
ORACLE = {
    **{name: _from_items(f"item_id, {sql} AS {name}") for name, sql in SQL_PREDICATES.items()},
    "clean_texts": _from_items(f"item_id, {_TRIM} AS cleaned, {_REASON} AS reason, ({_REASON}) IS NOT NULL AS filtered"),
    "clean_reason_counts": _from_items(f"entity_type, {_REASON} AS reason, count(*) AS items", "GROUP BY ALL"),
    "matches_language": _from_items("item_id, " + ", ".join(f"coalesce(regexp_matches(original_text, {_quote(P.LANGUAGE_RANGES[x])}), false) AS {x}" for x in ("zh", "en", "ja", "ko")) + ", false AS fr"),
    "non_source_language": _from_items(f"""item_id, CASE WHEN {_BLANK} THEN 'Empty' WHEN regexp_matches({_TRIM}, '^NOTE:') OR regexp_matches({_TRIM}, '^(Level|Width)\\s*[:=]') THEN 'CustomSkip'
  WHEN {SQL_PREDICATES['is_symbol']} THEN 'Symbol' WHEN {SQL_PREDICATES['is_number']} THEN 'Number' WHEN {SQL_PREDICATES['is_code']} THEN 'Code' WHEN {SQL_PREDICATES['is_tag']} THEN 'EngineeringTag'
  WHEN regexp_matches({_TRIM}, {_quote(P.LANGUAGE_RANGES['ja'])}) THEN 'TargetLang(ja)' WHEN NOT regexp_matches({_TRIM}, '[A-Za-z]') THEN 'NonSourceLang(en)' END AS reason"""),
    "trim_unicode": _from_items(f"item_id, {_TRIM} AS trimmed"),
    "sanitize_line": _from_items(f"item_id, {_SANITIZE.format('original_text')} AS line"),
    "strip_for_translation": _from_items(f"item_id, {_STRIP} AS plain"),
    "escape_and_normalize": _from_items(f"item_id, {_ESCAPE.format('original_text')} AS escaped"),
    "visual_width": _from_items(f"item_id, {_WIDTH.format('original_text')} AS width"),
    "detect_script": f"WITH {ITEMS_SQL} SELECT item_id, {_SCRIPT_SQL} AS script FROM (SELECT item_id, regexp_extract(coalesce(original_text, ''), {_quote(_UNION)}) AS c FROM items_once)",
    "encode_unicode": _from_items("item_id, CASE WHEN original_text IS NULL OR original_text = '' THEN original_text ELSE list_aggregate(list_transform(string_split(original_text, ''), lambda x: CASE WHEN unicode(x) < 128 THEN x WHEN unicode(x) < 65536 THEN '\\U+' || lpad(upper(to_hex(unicode(x))), 4, '0') ELSE '\\U+' || lpad(upper(to_hex(55296 + ((unicode(x) - 65536) >> 10))), 8, '0') || '\\U+' || lpad(upper(to_hex(56320 + ((unicode(x) - 65536) & 1023))), 8, '0') END), 'string_agg', '') END AS encoded"),
    "language_codes": _from_items(f"item_id, {_CODE_SQL.format('source_lang')} AS code"),
    "text_for_translation": _from_items(f"item_id, CASE WHEN coalesce(raw_original_text, '') <> '' THEN {_STRIP} ELSE original_text END AS text"),
    "unicode_style": f"WITH {ITEMS_SQL} SELECT item_id, CASE WHEN regexp_matches(original_text, '[^\\x{{00}}-\\x{{7F}}]') AND s <> 'Latin' THEN s || '_' || CASE WHEN coalesce(trim(layer_name), '') = '' THEN 'Standard' ELSE layer_name END ELSE layer_name END AS style FROM (SELECT *, {_SCRIPT_SQL} AS s FROM (SELECT *, regexp_extract(coalesce(original_text, ''), {_quote(_UNION)}) AS c FROM items_once))",
    "chunks_250": "WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id), n AS (SELECT *, greatest(1, ceil(length(text) / 250.0))::INT AS k FROM d) SELECT doc_id, i::INT AS chunk_no, CASE WHEN i = k - 1 THEN '1' ELSE '3' END AS code, substring(text, (i * 250 + 1)::BIGINT, 250) AS text FROM (SELECT *, unnest(range(k)) AS i FROM n)",
    "layout_scale": f"WITH {ITEMS_SQL}, w AS (SELECT item_id, {_WIDTH.format('translated_text')} AS width, {_WIDTH.format('original_text')} AS bound FROM items_once WHERE trim(translated_text, ' ') <> '') SELECT *, CASE WHEN bound > 0 AND width > bound THEN round(greatest(0.65, bound / width), 6) END AS scale FROM w",
    "languages": f"SELECT * FROM (VALUES {_LANGUAGE_VALUES}) v(code, is_primary, provider, provider_code)",
    "drawing_languages": f"SELECT DISTINCT path, provider, provider_code FROM drawings JOIN (VALUES {_LANGUAGE_VALUES}) v(code, is_primary, provider, provider_code) ON lower(code) = {_CODE_SQL.format('source_lang')}",
    "table_format": "SELECT DISTINCT path, acad_version, coalesce(acad_version, '') = '' OR acad_version >= 'AC1021' AS modern FROM drawings",
    "handle_parts": _from_items("item_id, coalesce(list_aggregate(list_transform(cad_handles, lambda h: '@_' || h || '_&f0'), 'string_agg', ','), '') AS id_string, coalesce(len(cad_handles), 0) > 1 AS is_merged, CASE WHEN table_row >= 0 AND table_column >= 0 THEN 'R' || table_row || ':C' || table_column ELSE '' END AS table_cell_ref, regexp_replace(handle, '(?i)::(?:R[0-9]+::C[0-9]+|CTX)$|:P[0-9]+$', '') AS owner"),
    "ai_response_parse": _from_items("item_id, 0 AS index, upper(ai_filter_decision) AS decision, 'r' AS reason", "WHERE ai_filter_decision IS NOT NULL"),
}
