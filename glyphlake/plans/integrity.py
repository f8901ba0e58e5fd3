"""Queries on references between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphlake.operators.orphan_refs import orphan_counts, orphan_references, references
from glyphlake.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(references(table(spark, sf_dir, "sheet_rows"), table(spark, sf_dir, "bridge_edits")), table(spark, sf_dir, "items"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p2_found(spark, sf_dir))


P2_FOUND_SQL = r"""
WITH keys AS (
  SELECT path, upper(trim(h)) AS handle, min(loaded_at) AS loaded_at,
         CASE WHEN count(erased_at) = count(*) THEN max(erased_at) END AS erased_at
  FROM (SELECT path, unnest(list_concat([handle], coalesce(cad_handles, []))) AS h, loaded_at, erased_at FROM items)
  WHERE trim(h) <> '' AND path IS NOT NULL GROUP BY 1, 2),
lists AS (
  SELECT 'sheet_rows' AS ref_table, sheet_row_id AS ref_row_id, 'id' AS ref_field, path, id AS v, loaded_at AS t FROM sheet_rows
  UNION ALL SELECT 'sheet_rows', sheet_row_id, 'all_handles', path, all_handles, loaded_at FROM sheet_rows
  UNION ALL SELECT 'bridge_edits', edit_id, 'id', path, id, sent_at FROM bridge_edits),
refs AS (
  SELECT DISTINCT ref_table, ref_row_id, ref_field, path, t, upper(regexp_replace(x, '^@_|_&f0$', '', 'gi')) AS handle
  FROM (SELECT *, unnest(regexp_split_to_array(v, '[;,；，、|\s]+')) AS x FROM lists) WHERE x <> ''),
j AS (
  SELECT r.*, CASE WHEN k.path IS NULL THEN 'missing' WHEN k.erased_at <= r.t THEN 'deleted' WHEN k.loaded_at > r.t THEN 'late' END AS kind
  FROM refs r LEFT JOIN keys k ON r.path = k.path AND r.handle = k.handle WHERE r.handle <> ''),
found AS (SELECT DISTINCT ref_table, ref_row_id, ref_field, handle, kind, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period FROM j WHERE kind IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
ORACLE = {
    "p2_found": P2_FOUND_SQL + "SELECT * FROM found",
    "p2_counts": P2_FOUND_SQL + "SELECT ref_table, ref_field, period, kind, count(*) AS orphans, count(DISTINCT ref_row_id) AS rows FROM found GROUP BY ALL",
}
