import pytest
from pyspark.sql import functions as F

from glyphlake.operators import glossary as G
from glyphlake.operators import merge as M
from glyphlake.operators import reconcile as R
from glyphlake.operators import translate as E
from glyphlake.operators.deliveries import first_delivery
from glyphlake.operators.layers import visible_items


def test_merge_dedup_fan_out(spark):
    rows = [("p", "Text", "Hello", "Hello", 1, 0, "hello", "H1"), ("p", "Text", "Hello", "Hello", 2, 1, "hello", "H2"), ("p", "Text", "Hello!", "Hello!", 3, 2, "hello", "H3"), ("p", "Text", "X", "X", 4, 3, " ", "H4"), ("p", "Attribute", "Hello", "Hello", 5, 4, "hello", "H5"), ("p", "Text", None, None, 6, 5, None, "H6")]
    df = spark.createDataFrame(rows, "path string, entity_type string, original_text string, raw_original_text string, item_id long, ord long, cleaned_text string, handle string")
    merged = M.merge_exact(df)
    assert {tuple(r["handles"]) for r in merged.collect()} == {("H1", "H2"), ("H3",), ("H4",), ("H5",), ("H6",)}
    dedup = {r["item_id"]: (r["handles"], r["block"]) for r in M.dedup_cleaned(merged).collect()}
    assert dedup == {1: (["H1", "H2", "H3"], 0), 5: (["H5"], 0), 4: (["H4"], 1), 6: (["H6"], 1)}
    assert M.fan_out(merged).count() == 6


def test_sheet_import(spark):
    items = spark.createDataFrame([(1, "p", 0, "a", ["a", "b"]), (2, "p", 1, "c", None), (3, "p", 2, "d", None), (4, "p", 3, "e", None)], "item_id long, path string, ord long, handle string, cad_handles array<string>")
    sheet = spark.createDataFrame([(1, "p", 2, "@_B_&f0", "", "T1"), (2, "p", 3, "", "C;X", "T2"), (3, "p", 4, "", "x", "T3"), (4, "p", 5, None, None, " ")], "sheet_row_id long, path string, row_no int, id string, all_handles string, translation string")
    hit = R.import_by_handle(items, sheet)
    assert {(r["item_id"], r["translation"]) for r in hit.collect()} == {(1, "T1"), (2, "T2")}
    rest = R.positional_fallback(items, sheet, hit)
    assert {(r["item_id"], r["sheet_row_id"], r["translation"]) for r in rest.collect()} == {(3, 3, "T3"), (4, 4, None)}


def test_positional_import_is_strict_for_equal_counts(spark):
    items = spark.createDataFrame([(1, "p", 0, "A"), (2, "p", 1, "B"), (3, "q", 0, "A"), (4, "q", 1, "B")], "item_id long, path string, ord long, original_text string")
    sheet = spark.createDataFrame([(1, "p", 2, "A", "a"), (2, "p", 3, "Z", "z"), (3, "q", 2, "Z", "z")], "sheet_row_id long, path string, row_no int, source string, translation string")
    got = {r["item_id"]: (r["translation"], r["error"]) for r in R.import_by_position(items, sheet).collect()}
    assert got == {1: (None, 2), 2: (None, 2), 3: ("z", None)}


def test_edit_precedence(spark):
    items = spark.createDataFrame([(1, "p", "a", ["a", "b"], "T"), (2, "p", "c", None, "U"), (3, "p", "d", None, "V")], "item_id long, path string, handle string, cad_handles array<string>, original_text string")
    edits = spark.createDataFrame([("p", "@_A_&f0,@_B_&f0", None, "id", 1), ("p", "a", None, "one", 2), ("p", "C", None, "old", 1), ("p", "@_c_&f0", None, "new", 2), ("p", "", "V ", "text", 1), ("q", "d", None, "no", 9)], "path string, id string, original string, translated string, seq int")
    got = {r["item_id"]: (r["translated"], r["matched_by"]) for r in R.resolve_edits(items, edits).collect()}
    assert got == {1: ("id", "id"), 2: ("new", "id"), 3: ("text", "text")}


def fold(original, translated, terms):
    text, seen, n = translated, translated, 0
    for s, t, exact in sorted(terms, key=lambda x: (-len(x[0]), x[0])):
        has = (lambda a, b: b in a) if exact else (lambda a, b: b.lower() in a.lower())
        if not has(original, s):
            continue
        if original == s or not exact and original.lower() == s.lower():
            text, n = t, n + 1
        elif has(seen, s):
            import re

            text = text.replace(s, t) if exact else re.sub(re.escape(s), lambda m: t, text, flags=re.I)
            seen, n = text, n + 1
    return text, n


def test_glossary_fold_against_brute_force(spark):
    terms = [("bolt", "螺栓", False), ("bolt hole", "栓孔", False), ("Steel", "钢", True), ("(x)", "$1", False)]
    glossary = spark.createDataFrame([(s, t, "en" if i % 2 else "", "ZH", e, False) for i, (s, t, e) in enumerate(terms)] + [("regex", "r", "en", "zh", False, True), ("bolt", "de", "de", "zh", False, False)], "source_term string, target_term string, source_lang string, target_lang string, is_case_sensitive boolean, is_regex boolean")
    rows = [(1, "a Bolt hole", "the BOLT HOLE bolt"), (2, "bolt", "x"), (3, "steel Steel", "Steel steel"), (4, "(X) y", "has (x) in"), (5, "none", "none"), (6, "bolt", None), (7, None, "z")]
    got = {r["item_id"]: (r["translated_text"], r["replaced"]) for r in G.apply_glossary(spark.createDataFrame(rows, "item_id long, original_text string, translated_text string"), glossary, "EN", "zh").collect()}
    assert got == {i: fold(o or "", t, terms) for i, o, t in rows if t}


def test_engines(spark):
    rows = spark.createDataFrame([(1, None, "a", None), (2, r"\A1;a", "x", None), (3, None, "b", "done"), (4, None, " ", None), (5, None, "c", None)], "item_id long, raw_original_text string, original_text string, translated_text string")
    seen = E.translate_items(rows, E.make_engine("dictionary", {"a": "A", "c": " "}), "en", "zh")
    assert {r["item_id"]: r["translated_text"] for r in seen.collect()} == {1: "A", 2: "A", 3: "done", 4: None, 5: None}
    with pytest.raises(Exception, match="translations for"):
        E.translate_items(rows, lambda t, s, g: [], "en", "zh").collect()
    with pytest.raises(ValueError):
        E.make_engine("nope")
    with pytest.raises(NotImplementedError):
        E.make_engine("DeepL")


def test_layers(spark):
    items = spark.createDataFrame([(1, "p", "a", "Text"), (2, "p", "B", "Text"), (3, "p", "", "Text"), (4, "p", None, "Text"), (5, "p", "A", "MLeader"), (6, "q", "A", "Text")], "item_id long, path string, layer_name string, entity_type string")
    layers = spark.createDataFrame([("p", "A", True, False, None), ("p", "b", False, True, False)], "path string, name string, frozen boolean, locked boolean, off boolean")
    ids = lambda df: sorted(r[0] for r in df.select("item_id").collect())
    assert ids(visible_items(items, layers)) == [3, 4, 5, 6]
    assert ids(visible_items(items, layers, frozen=True)) == [1, 3, 4, 5, 6]
    assert ids(visible_items(items, layers, leaders=True)) == [3, 4, 6]


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, None, "x"), (2, 1, "y")], "k long, at long, v string")
    assert {(r["k"], r["v"]) for r in first_delivery(df, "k", "at").collect()} == {(1, "a"), (2, "x")}
    assert first_delivery(df.where(F.lit(False)), "k", "at").count() == 0
