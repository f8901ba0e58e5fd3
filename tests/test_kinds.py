"""Write-back of all five kinds of items."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from glyphlake.functions.mtext import rebuild
from glyphlake.plans.texts import items

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def line(raw):
    return "".join(c for c in raw.translate({13: " ", 10: " ", 9: " "}) if c >= " ")


def test_every_kind_is_written(spark):
    rows = items(spark, DATA, "path", "handle", "entity_type", "raw_original_text").where("raw_original_text is not null").collect()
    want = {}
    for r in rows:
        raw = r["raw_original_text"].translate({13: " ", 10: " ", 9: " "}) if r["entity_type"] == "MText" else line(r["raw_original_text"])
        text = f"T:{r['handle']}"
        if raw.strip().lstrip("+-").isdigit():
            text = raw.strip(" ") if r["entity_type"] in ("TableCell", "MLeader") else raw
        elif r["entity_type"] == "MText":
            text = rebuild(raw, text, 50.0)
        want[r["path"], r["entity_type"], r["handle"].strip().upper()] = text
    got = {(r["path"], r["entity_type"], r["key"]): r["text"] for r in entry.queries()["write_back_kinds"](spark, DATA).collect()}
    assert {k[1] for k in want} == {"Text", "MText", "Attribute", "TableCell", "MLeader"} and got == want


def test_every_kind_is_extracted(spark):
    kinds = Counter(r["entity_type"] for r in items(spark, DATA, "entity_type", "raw_original_text").where(F.col("raw_original_text").rlike(r"\w")).collect())
    got = entry.queries()["extract_items"](spark, DATA).groupBy("entity_type").agg(F.sum("items")).collect()
    assert {r[0] for r in got} == set(kinds) and all(r[1] >= kinds[r[0]] for r in got)
