"""Orphan references by dictionary-encoded keys and compressed bitmaps.

The keys ``(path, HANDLE)`` of both sides, parents and references, form one
dictionary: they are spread over hash ranges and numbered densely inside each.
Every 65,536 numbers of a range have one compressed bitmap (module ``bitmaps``)
for each month of reference, of loading and of erasing.  The parent bitmap of a
month holds the keys that were loaded before it began and not erased by its
end; ``reference AND NOT parent`` leaves the references that may be orphans,
whether their key is unknown, erased or loaded later.  The surviving bits are
decoded by the dictionary, and only they are compared by exact time.

Only distinct keys by month are numbered and sent to Python, so a key that a
third of all rows refer to is one bit a month.

Defined cases: null or blank reference fields and list entries refer to nothing;
a null path is a path without items, so its references are ``missing``; parents
without path or handle are none; repeated rows give one result; an empty parent
table makes every reference ``missing``; a reference without time has a null
period and is reported only if ``missing``.  Where several parents share a key,
the reference is good if any of them is: the earliest load counts, and the key
counts as erased only when all of them are, at the last of their times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators import bitmaps
from glyphlake.runtime import shuffle_width

#: The month of a reference without time, that of a parent's row, and the time of what has none.
NEVER, PARENT, NO_TIME = -1, -2, -(1 << 62)


def parse_handles(col: Column) -> Column:
    """Handles of an id list, a handle list or one bare handle, in upper case.

    Entries are parted by ``;``, ``,`` and their wide forms or blanks;
    ``@_<handle>_&f0`` is unwrapped; blank entries vanish; null gives null.
    """
    parts = F.split(col, r"[;,；，、|\s]+")
    bare = F.transform(parts, lambda x: F.upper(F.regexp_replace(x, r"(?i)^@_|_&f0$", "")))
    return F.array_distinct(F.filter(bare, lambda x: F.length(x) > 0))


def parent_keys(items: DataFrame) -> DataFrame:
    """``path, handle, loaded_at, erased_at`` of every handle of every item."""
    named = F.transform(F.concat(F.array("handle"), F.coalesce("cad_handles", F.array().cast("array<string>"))), lambda h: F.upper(F.trim(h)))
    keys = F.explode(F.array_distinct(F.filter(named, lambda h: h.isNotNull() & (F.length(h) > 0))))
    return items.where("path is not null").select("path", keys.alias("handle"), "loaded_at", "erased_at")


def utc_date(col: Column) -> Column:
    """The UTC date of a time, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(col) / 86400).cast("int"))


def month_no(col: Column) -> Column:
    return F.year(utc_date(col)) * 12 + F.month(utc_date(col)) - 1


def key_dictionary(references: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """``rng, kid, path, handle, month, loaded, erased``: the numbered keys.

    One row for each key and month of reference, and one for each key that has
    parents (its month is ``PARENT``); times are in microseconds.
    """
    n = ranges or 4 * shuffle_width(references.sparkSession)
    of_refs = references.select("path", "handle", F.coalesce(month_no(F.col("at")), F.lit(NEVER)).alias("month"), F.lit(None).cast("long").alias("loaded"), F.lit(None).cast("long").alias("erased"))
    of_parents = parents.select("path", "handle", F.lit(PARENT).alias("month"), F.unix_micros("loaded_at").alias("loaded"), F.unix_micros("erased_at").alias("erased"))
    keys = of_refs.unionByName(of_parents).groupBy("path", "handle", "month").agg(
        F.coalesce(F.min("loaded"), F.lit(NO_TIME)).alias("loaded"),
        F.coalesce(F.when(F.count("erased") == F.count(F.lit(1)), F.max("erased")), F.lit(NO_TIME)).alias("erased"),
    )
    rng = F.pmod(F.xxhash64("path", "handle"), F.lit(n)).cast("int")
    number = F.dense_rank().over(Window.partitionBy("rng").orderBy("path", "handle")) - 1
    return keys.withColumn("rng", rng).withColumn("kid", number)


def _by_month(micros_or_months: np.ndarray, numbers: np.ndarray, micros: bool = False) -> dict[int, bytes]:
    """A bitmap of the numbers of each month, in the order of the months."""
    months = micros_or_months
    if micros:
        months = months.astype("datetime64[us]").astype("datetime64[M]").astype(np.int64) + 12 * 1970
    return {int(m): bitmaps.pack(np.unique(numbers[months == m])) for m in np.unique(months)}


def surviving(keys: pd.DataFrame) -> pd.DataFrame:
    """The references of one bitmap's keys whose bit the parent bitmap of their month lacks, decoded."""
    low = (keys["kid"].to_numpy() & (bitmaps.SPAN - 1)).astype(np.int64)
    month, load, erase = (keys[c].to_numpy() for c in ("month", "loaded", "erased"))
    own = month == PARENT
    known, gone = own & (load != NO_TIME), own & (erase != NO_TIME)
    loaded, erased = _by_month(load[known], low[known], True), _by_month(erase[gone], low[gone], True)
    loads, ends = list(loaded), list(erased)
    keep = np.zeros(len(keys), dtype=bool)
    before = dead = bitmaps.pack(low[:0])
    for m, asked in _by_month(month[~own], low[~own]).items():
        # What is loaded in the month itself may be later than the reference.
        while loads and loads[0] < m:
            before = bitmaps.union(before, loaded[loads.pop(0)])
        while ends and ends[0] <= m:
            dead = bitmaps.union(dead, erased[ends.pop(0)])
        left = bitmaps.and_not(asked, bitmaps.and_not(before, dead))
        mine = month == m
        keep[mine] = bitmaps.has(left, low[mine])
    parent = np.full(bitmaps.SPAN, -1, dtype=np.int64)
    parent[low[own]] = np.flatnonzero(own)
    at = parent[low[keep]]
    has = at >= 0
    return keys.loc[keep, ["path", "handle", "month"]].assign(has=has, loaded=np.where(has, load[at], NO_TIME), erased=np.where(has, erase[at], NO_TIME))


def orphan_references(references: DataFrame, items: DataFrame, ranges: int | None = None) -> DataFrame:
    """``ref_table, ref_row_id, ref_field, handle, kind, period`` of every orphan.

    ``references`` has ``ref_table, ref_row_id, ref_field, path, handle, at``.
    """
    refs = references.select("ref_table", "ref_row_id", "ref_field", "path", "handle", "at")
    keys = key_dictionary(refs, parent_keys(items), ranges)
    left = keys.groupBy("rng", F.shiftright("kid", 16).alias("chunk")).applyInPandas(surviving, "path string, handle string, month int, has boolean, loaded long, erased long")
    left = left.withColumnsRenamed({"path": "_path", "handle": "_handle", "month": "_month"})
    of_key = F.col("path").eqNullSafe(F.col("_path")) & (F.col("handle") == F.col("_handle")) & (F.coalesce(month_no(F.col("at")), F.lit(NEVER)) == F.col("_month"))
    at = F.unix_micros("at")
    kind = F.when(~F.col("has"), "missing").when((F.col("erased") != NO_TIME) & (F.col("erased") <= at), "deleted").when(F.col("loaded") > at, "late")
    found = refs.join(left, of_key).withColumn("kind", kind).where("kind is not null")
    return found.select("ref_table", "ref_row_id", "ref_field", "handle", "kind", F.date_format(utc_date(F.col("at")), "yyyy-MM").alias("period")).distinct()


def references(sheet_rows: DataFrame, bridge_edits: DataFrame) -> DataFrame:
    """The handle references of the review sheets and of the agents' edits."""

    def of(df: DataFrame, name: str, key: str, field: str, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_row_id"), F.lit(field).alias("ref_field"), "path", F.explode(parse_handles(F.col(field))).alias("handle"), F.col(at).alias("at"))

    s = sheet_rows.select(
        "sheet_row_id", "path", F.col("loaded_at").alias("at"),
        F.explode(F.array(F.struct(F.lit("id").alias("f"), parse_handles(F.col("id")).alias("hs")), F.struct(F.lit("all_handles").alias("f"), parse_handles(F.col("all_handles")).alias("hs")))).alias("e"),
    )
    sheets = s.select(F.lit("sheet_rows").alias("ref_table"), F.col("sheet_row_id").alias("ref_row_id"), F.col("e.f").alias("ref_field"), "path", F.explode("e.hs").alias("handle"), "at")
    return sheets.unionByName(of(bridge_edits, "bridge_edits", "edit_id", "id", "sent_at"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per referring table, field, month and kind."""
    return found.groupBy("ref_table", "ref_field", "period", "kind").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_row_id").alias("rows"))
