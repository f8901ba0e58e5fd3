"""Queries on sets of items: merging, layers, review sheets, edits, glossary, engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import predicates as P
from glyphlake.functions.text import id_string
from glyphlake.operators import glossary as G
from glyphlake.operators import merge as M
from glyphlake.operators import reconcile as R
from glyphlake.operators import translate as E
from glyphlake.operators.deliveries import first_delivery
from glyphlake.operators.layers import visible_items
from glyphlake.plans.texts import _TRIM, ITEMS_SQL, SQL_PREDICATES, items
from glyphlake.runtime import table


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "sheet_rows").select("sheet_row_id", "path", "row_no", "id", "source", "translation", "all_handles", "loaded_at"), "sheet_row_id", "loaded_at")


SHEET_SQL = "sheet AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_row_id ORDER BY loaded_at) AS delivery FROM sheet_rows) WHERE delivery = 1)"
_SPLIT = r"'[;,；，、|\s]+'"


def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_items(items(spark, sf_dir, "path", "layer_name", "entity_type"), table(spark, sf_dir, "layers")).select("item_id")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_exact(items(spark, sf_dir, "path", "ord", "handle", "entity_type", "original_text", "raw_original_text", "cleaned_text"))


def merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("handles", F.array_join("handles", ";"))


def dedup_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedup_cleaned(_merged(spark, sf_dir)).withColumn("handles", F.array_join("handles", ";"))


def fan_out_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fan_out(_merged(spark, sf_dir)).select("item_id", "member", "handle")


def translation_only_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.translation_export(items(spark, sf_dir, "path", "ord", "original_text", "translated_text", "cleaned_text"))


def truly_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.truly_translated(items(spark, sf_dir, "path", "original_text", "translated_text")).groupBy("path").agg(F.count(F.lit(1)).alias("translated"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per type, and of them candidates with text."""
    return items(spark, sf_dir, "entity_type", "original_text").groupBy("entity_type").agg(F.count(F.lit(1)).alias("items"), F.count_if(~P.is_blank(F.col("original_text"))).alias("candidates"))


def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "original_text", "translated_text").where(P.is_blank(F.col("translated_text")) & ~P.is_blank(F.col("original_text"))).select("item_id")


def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.carry_over(items(spark, sf_dir, "path", "ord", "original_text", "translated_text"))


def _by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.import_by_handle(items(spark, sf_dir, "path", "ord", "handle", "cad_handles"), sheet(spark, sf_dir))


def handle_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_handle(spark, sf_dir).select("item_id", "sheet_row_id", "translation")


def positional_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir, "path", "ord", "handle", "cad_handles")
    rows = sheet(spark, sf_dir)
    return R.positional_fallback(it, rows, R.import_by_handle(it, rows)).select("item_id", "sheet_row_id", "translation")


def legacy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.import_by_position(items(spark, sf_dir, "path", "ord", "original_text"), sheet(spark, sf_dir)).select("item_id", "translation", "error")


def unmatched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir, "path", "ord", "handle", "cad_handles")
    return it.join(R.import_by_handle(it, sheet(spark, sf_dir)).select("item_id"), "item_id", "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("unmatched"))


def three_way_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "bridge_edits").select("path", "id", F.lit(None).cast("string").alias("original"), "translated", F.struct("sent_at", "edit_id").alias("seq")).distinct()
    return R.resolve_edits(items(spark, sf_dir, "path", "handle", "cad_handles", "original_text"), edits)


def rich_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir).withColumn("translated_text", F.lit(None).cast("string"))
    return R.rich_sheet(merged)


def legacy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plain_sheet(items(spark, sf_dir, "path", "ord", "original_text", "translated_text"))


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.matching_terms(table(spark, sf_dir, "glossary"), "en", "zh").select("source_term", "target_term", "source_lang", "category").distinct()


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.term_hits(items(spark, sf_dir, "original_text"), table(spark, sf_dir, "glossary"), "en", "zh")


def glossary_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.apply_glossary(items(spark, sf_dir, "original_text", "translated_text"), table(spark, sf_dir, "glossary"), "en", "zh")


def engine_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.translate_items(items(spark, sf_dir, "original_text", "raw_original_text", "translated_text"), E.make_engine("marker"), "auto", "en")


def ai_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.prefilter(items(spark, sf_dir, "original_text", "status", "entity_type", "table_row"))


def ai_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a judge that answers the even indices of each batch of 50 only."""
    numbered = E.batches(items(spark, sf_dir, "path", "ord"), 50)
    answers = numbered.where("idx % 2 = 0").select("path", "batch", "idx", F.when(F.col("idx") % 4 == 0, "SKIP").otherwise("KEEP").alias("decision"))
    return E.apply_decisions(numbered, answers)


_CLEAN_BLANK = "(cleaned_text IS NULL OR regexp_full_match(cleaned_text, '[\\t-\\r\\x{85}\\p{Z}]*'))"
_T_BLANK = _CLEAN_BLANK.replace("cleaned_text", "translated_text")
_TRANSLATED = f"(NOT {_T_BLANK} AND translated_text IS DISTINCT FROM original_text)"
_MERGED = f"""WITH {ITEMS_SQL}, merged AS (
  SELECT path, entity_type, original_text, raw_original_text, arg_min(item_id, ord) AS item_id, min(ord) AS ord, (list(cleaned_text ORDER BY ord))[1] AS cleaned_text, list(handle ORDER BY ord) AS handles, count(*) AS items
  FROM items_once GROUP BY 1, 2, 3, 4)"""
_KEYS = rf"""cand AS (SELECT path, item_id, ord, upper(trim(h)) AS key, i AS rank FROM (SELECT path, item_id, ord, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT *, list_concat(coalesce(cad_handles, []), [handle]) AS hs FROM items_once)) WHERE trim(h) <> ''),
names AS (SELECT DISTINCT path, row_no, sheet_row_id, translation, upper(regexp_replace(x, '^@_|_&f0$', '', 'gi')) AS key FROM (SELECT *, unnest(list_concat(regexp_split_to_array(coalesce(id, ''), {_SPLIT}), regexp_split_to_array(coalesce(all_handles, ''), {_SPLIT}))) AS x FROM sheet) WHERE x <> ''),
last_name AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, key ORDER BY row_no DESC, sheet_row_id DESC) AS k FROM names) WHERE k = 1 AND key <> ''),
matched AS (SELECT * FROM (SELECT c.path, c.item_id, c.ord, l.sheet_row_id, l.translation AS translated_text, row_number() OVER (PARTITION BY c.item_id ORDER BY c.rank, l.sheet_row_id) AS k FROM cand c JOIN last_name l ON c.path = l.path AND c.key = l.key) WHERE k = 1)"""
_BLANK_TO_NULL = f"CASE WHEN NOT {_T_BLANK} THEN translated_text END AS translation"
_TRIM_SOURCE = _TRIM.replace("original_text", "coalesce(source, '')")
_FITS = "(coalesce(trim({0}), '') = '' OR lower(trim({0})) = '{1}')"
_TERMS = f"terms AS (SELECT DISTINCT source_term, target_term, source_lang, category, is_case_sensitive FROM glossary WHERE {_FITS.format('source_lang', 'en')} AND {_FITS.format('target_lang', 'zh')} AND NOT coalesce(is_regex, false) AND coalesce(source_term, '') <> '')"

QUERIES = {
    "layer_filter": layer_filter,
    "merge_exact": merge_exact,
    "dedup_cleaned": dedup_cleaned,
    "fan_out_members": fan_out_members,
    "translation_only_export": translation_only_export,
    "truly_translated": truly_translated,
    "entity_counts": entity_counts,
    "needs_translation": needs_translation,
    "carry_over": carry_over,
    "handle_import": handle_import,
    "positional_fallback": positional_fallback,
    "legacy_import": legacy_import,
    "unmatched_items": unmatched_items,
    "three_way_lookup": three_way_lookup,
    "rich_export": rich_export,
    "legacy_export": legacy_export,
    "glossary_terms": glossary_terms,
    "glossary_hits": glossary_hits,
    "glossary_apply": glossary_apply,
    "engine_marker": engine_marker,
    "ai_prefilter": ai_prefilter,
    "ai_decisions": ai_decisions,
}
ORACLE = {
    "layer_filter": f"WITH {ITEMS_SQL}, hidden AS (SELECT path, upper(name) AS name, bool_or(coalesce(frozen, false) OR coalesce(locked, false) OR coalesce(off, false)) AS h FROM layers GROUP BY 1, 2) SELECT item_id FROM items_once i LEFT JOIN hidden l ON i.path = l.path AND upper(i.layer_name) = l.name WHERE i.entity_type = 'MLeader' OR trim(coalesce(i.layer_name, '')) = '' OR NOT coalesce(l.h, false)",
    "merge_exact": _MERGED + " SELECT * REPLACE (list_aggregate(handles, 'string_agg', ';') AS handles) FROM merged",
    "dedup_cleaned": _MERGED + f" SELECT path, entity_type, cleaned_text, arg_min(item_id, ord) AS item_id, min(ord) AS ord, (list(original_text ORDER BY ord))[1] AS original_text, list_aggregate(flatten(list(handles ORDER BY ord)), 'string_agg', ';') AS handles, sum(items)::BIGINT AS items, 0 AS block FROM merged WHERE NOT {_CLEAN_BLANK} GROUP BY path, entity_type, cleaned_text UNION ALL SELECT path, entity_type, cleaned_text, item_id, ord, original_text, list_aggregate(handles, 'string_agg', ';'), items, 1 FROM merged WHERE {_CLEAN_BLANK}",
    "fan_out_members": _MERGED + " SELECT item_id, (generate_subscripts(handles, 1) - 1)::INT AS member, unnest(handles) AS handle FROM merged",
    "translation_only_export": f"WITH {ITEMS_SQL}, k AS (SELECT *, {_TRIM.replace('original_text', 'coalesce(cleaned_text, original_text)')} AS source FROM items_once WHERE {_TRANSLATED} AND NOT {SQL_PREDICATES['is_non_textual']}) SELECT path, source, arg_min(translated_text, ord) AS translation, arg_min(item_id, ord) AS item_id FROM k GROUP BY 1, 2",
    "truly_translated": f"WITH {ITEMS_SQL} SELECT path, count(*) AS translated FROM items_once WHERE {_TRANSLATED} GROUP BY 1",
    "entity_counts": f"WITH {ITEMS_SQL} SELECT entity_type, count(*) AS items, count(*) FILTER (NOT {_CLEAN_BLANK.replace('cleaned_text', 'original_text')}) AS candidates FROM items_once GROUP BY 1",
    "needs_translation": f"WITH {ITEMS_SQL} SELECT item_id FROM items_once WHERE {_T_BLANK} AND NOT {_CLEAN_BLANK.replace('cleaned_text', 'original_text')}",
    "carry_over": f"WITH {ITEMS_SQL}, k AS (SELECT *, lower({_TRIM}) AS key FROM items_once), known AS (SELECT path, key, arg_max(translated_text, ord) AS prior FROM k WHERE {_TRANSLATED} AND key IS NOT NULL GROUP BY 1, 2) SELECT item_id, CASE WHEN {_T_BLANK} THEN coalesce(prior, translated_text) ELSE translated_text END AS translated_text, {_T_BLANK} AND prior IS NOT NULL AS carried FROM k LEFT JOIN known USING (path, key)",
    "handle_import": f"WITH {ITEMS_SQL}, {SHEET_SQL}, {_KEYS} SELECT item_id, sheet_row_id, {_BLANK_TO_NULL} FROM matched",
    "positional_fallback": f"WITH {ITEMS_SQL}, {SHEET_SQL}, {_KEYS}, a AS (SELECT path, item_id, row_number() OVER (PARTITION BY path ORDER BY ord, item_id) AS n FROM items_once WHERE item_id NOT IN (SELECT item_id FROM matched)), b AS (SELECT path, sheet_row_id, translation AS translated_text, row_number() OVER (PARTITION BY path ORDER BY row_no, sheet_row_id) AS n FROM sheet WHERE sheet_row_id NOT IN (SELECT sheet_row_id FROM matched)) SELECT item_id, sheet_row_id, {_BLANK_TO_NULL} FROM a JOIN b USING (path, n)",
    "legacy_import": f"WITH {ITEMS_SQL}, {SHEET_SQL}, a AS (SELECT path, item_id, original_text, row_number() OVER (PARTITION BY path ORDER BY ord, item_id) AS n, count(*) OVER (PARTITION BY path) AS ni FROM items_once), b AS (SELECT path, source, translation AS translated_text, row_number() OVER (PARTITION BY path ORDER BY row_no, sheet_row_id) AS n, count(*) OVER (PARTITION BY path) AS nr FROM sheet), m AS (SELECT *, min(CASE WHEN ni = nr AND {_TRIM.replace('original_text', 'coalesce(original_text, chr(0))').replace('chr(0)', chr(39) * 2)} IS DISTINCT FROM {_TRIM_SOURCE} THEN n END) OVER (PARTITION BY path) AS error FROM a JOIN b USING (path, n)) SELECT item_id, CASE WHEN error IS NULL AND NOT {_T_BLANK} THEN translated_text END AS translation, error FROM m",
    "unmatched_items": f"WITH {ITEMS_SQL}, {SHEET_SQL}, {_KEYS} SELECT path, count(*) AS unmatched FROM items_once WHERE item_id NOT IN (SELECT item_id FROM matched) GROUP BY 1",
    "three_way_lookup": rf"WITH {ITEMS_SQL}, e AS (SELECT DISTINCT path, edit_id, sent_at, translated, upper(regexp_replace(id, '\s+', '', 'g')) AS k_id, list_filter(regexp_split_to_array(id, {_SPLIT}), lambda x: x <> '') AS hs FROM bridge_edits), by_id AS (SELECT path, k_id AS key, arg_max(translated, (sent_at, edit_id)) AS t FROM e WHERE k_id <> '' GROUP BY 1, 2), one AS (SELECT path, upper(regexp_replace(hs[1], '^@_|_&f0$', '', 'gi')) AS key, sent_at, edit_id, translated, len(list_distinct(hs)) AS n FROM e), by_handle AS (SELECT path, key, arg_max(translated, (sent_at, edit_id)) AS t FROM one WHERE n = 1 AND key <> '' GROUP BY 1, 2), k AS (SELECT *, upper(list_aggregate(list_transform(coalesce(cad_handles, [handle]), lambda h: '@_' || h || '_&f0'), 'string_agg', ',')) AS k1, upper(trim(handle)) AS k2 FROM items_once) SELECT item_id, coalesce(a.t, b.t) AS translated, CASE WHEN a.t IS NOT NULL THEN 'id' ELSE 'handle' END AS matched_by FROM k LEFT JOIN by_id a ON k.path = a.path AND k.k1 = a.key LEFT JOIN by_handle b ON k.path = b.path AND k.k2 = b.key WHERE coalesce(a.t, b.t) IS NOT NULL",
    "rich_export": _MERGED + f" SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord) + 1)::INT AS row_no, list_aggregate(list_transform(handles, lambda h: '@_' || h || '_&f0'), 'string_agg', ',') AS id, original_text AS source, NULL::VARCHAR AS translation, CASE WHEN len(handles) > 1 THEN list_aggregate(handles, 'string_agg', ';') ELSE '' END AS all_handles FROM merged WHERE NOT {SQL_PREDICATES['is_non_textual']}",
    "legacy_export": f"WITH {ITEMS_SQL} SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord, item_id) + 1)::INT AS row_no, original_text AS source, translated_text AS translation FROM items_once",
    "glossary_terms": f"WITH {_TERMS} SELECT DISTINCT source_term, target_term, source_lang, category FROM terms",
    "glossary_hits": f"WITH {ITEMS_SQL}, {_TERMS} SELECT DISTINCT item_id, source_term FROM items_once, terms WHERE CASE WHEN is_case_sensitive THEN contains(original_text, source_term) ELSE contains(lower(original_text), lower(source_term)) END",
    "ai_prefilter": f"WITH {ITEMS_SQL} SELECT item_id, CASE WHEN {_CLEAN_BLANK.replace('cleaned_text', 'original_text')} OR status = 'skipped' THEN 'SKIP' WHEN entity_type = 'TableCell' AND table_row = 0 THEN 'KEEP' END AS decision FROM items_once",
    "ai_decisions": f"WITH {ITEMS_SQL}, n AS (SELECT item_id, (row_number() OVER (PARTITION BY path ORDER BY ord, item_id) - 1) % 50 AS idx FROM items_once) SELECT item_id, CASE WHEN idx % 4 = 0 THEN 'SKIP' ELSE 'KEEP' END AS decision FROM n",
}
