import pytest
from pyspark.sql import functions as F

from glyphlake.operators import entities as N
from glyphlake.operators import writeback as W
from glyphlake.operators.extract import ExtractConfig, extract_items, merge_paragraphs
from glyphlake.plans import pipeline
from glyphlake.sources import dxf, glossary, sheet


def pairs(spark, *rows, path="d"):
    return spark.createDataFrame([(path, i, c, v, 2 * i + 1) for i, (c, v) in enumerate(rows)], "path string, pair_idx int, code int, value string, value_line int")


def drawing(version="AC1032"):
    rows = [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, version), (0, "ENDSEC"), (0, "SECTION"), (2, "TABLES"), (0, "TABLE"), (2, "LAYER"), (0, "LAYER"), (2, "Ice"), (70, "1"), (62, "7"), (0, "LAYER"), (2, "Dark"), (70, "4"), (62, "-7"), (0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES")]
    rows += [(0, "TEXT"), (5, "30"), (8, "0"), (40, "2.5"), (1, "Steel beam"), (0, "TEXT"), (5, "31"), (8, "ICE"), (1, "Hidden"), (0, "TEXT"), (5, "32"), (1, "1500")]
    rows += [(0, "INSERT"), (5, "2A"), (0, "ATTRIB"), (5, "2B"), (2, "TITLE"), (1, "Plan"), (0, "ATTRIB"), (2, ""), (1, "no tag"), (0, "SEQEND"), (0, "ATTRIB"), (2, "REV"), (1, "A")]
    rows += [(0, "MTEXT"), (5, "40"), (8, "0"), (40, "2.0"), (41, "50.5"), (3, "AAA"), (1, r"BBB\PCCC"), (0, "MTEXT"), (5, "41"), (3, "only chunk")]
    rows += [(0, "ACAD_TABLE"), (5, "1A6"), (8, "L"), (91, "2"), (92, "2")] + [x for t in ("Header A", "Header B", r"{\H1.5x;Data 1}", "block") for x in ((301, "CELL"), (171, "2" if t == "block" else "1"), (302, t))] + [(301, "C"), (171, "1"), (302, "too many")]
    rows += [(0, "MULTILEADER"), (5, "1A7"), (172, "2"), (304, "before"), (300, "CONTEXT"), (304, "First"), (304, "Second"), (340, "2F"), (41, "50.5"), (301, "}")]
    return rows + [(0, "ENDSEC"), (0, "EOF")]


def test_entities(spark):
    p = pairs(spark, *drawing())
    found = N.with_entities(p)
    assert {(r["handle"], r["text"], r["section"]) for r in N.texts(found).collect()} == {("30", "Steel beam", "ENTITIES"), ("31", "Hidden", "ENTITIES"), ("32", "1500", "ENTITIES")}
    m = {r["handle"]: r for r in N.mtexts(found).collect()}
    assert m["40"]["text"] == r"AAABBB\PCCC" and m["40"]["rect_width"] == 50.5 and len(m["40"]["code3_lines"]) == 1 and m["41"]["last_code1_line"] is None
    assert {(r["insert_handle"], r["tag"]) for r in N.attributes(found).collect()} == {("2A", "TITLE"), ("", "REV")}
    assert {(r["row"], r["column"], r["cell_type"], r["text"]) for r in N.cells(found, p).collect()} == {(0, 0, 1, "Header A"), (0, 1, 1, "Header B"), (1, 0, 1, r"{\H1.5x;Data 1}"), (1, 1, 2, "block")}
    assert [(r["handle"], r["text"], r["style_handle"], r["boundary_width"]) for r in N.leaders(found).collect()] == [("1A7", "Second", "2F", 50.5)]
    assert {(r["name"], r["frozen"], r["locked"], r["off"]) for r in N.layer_states(found).collect()} == {("Ice", True, False, False), ("Dark", False, True, True)}


def test_old_tables(spark):
    rows = [(9, "$ACADVER"), (1, "AC1015"), (0, "ACAD_TABLE"), (5, "CC"), (91, "1"), (92, "2"), (171, "1"), (3, "A" * 250), (1, "END"), (171, "1"), (1, "B"), (0, "ACAD_TABLE"), (5, "DD"), (91, "0"), (92, "0"), (171, "1"), (1, "x")]
    p = pairs(spark, *rows)
    got = N.cells(N.with_entities(p), p).collect()
    assert {(r["column"], r["text"], len(r["rest_lines"])) for r in got} == {(0, "A" * 250 + "END", 1), (1, "B", 0)}


def test_extract(spark):
    got = {r["handle"]: r for r in extract_items(pairs(spark, *drawing())).collect()}
    assert set(got) == {"30", "32", "2A::TITLE", "::REV", "40", "41", "1A6::R0::C0", "1A6::R0::C1", "1A6::R1::C0", "1A7::CTX"}
    assert got["1A6::R1::C0"]["original_text"] == "Data 1" and got["32"]["filter_reason"] == "Number" and got["30"]["ord"] == 0
    few = extract_items(pairs(spark, *drawing()), ExtractConfig(attributes=False, tables=False, leaders=False, mtext_whole=False, mtext_paragraphs=True, drop_skipped=True, frozen_layers=True))
    assert {r["handle"] for r in few.collect()} == {"30", "31", "40:P0", "40:P1", "41:P0"}
    back = merge_paragraphs(few.withColumn("translated_text", F.concat(F.lit("t"), "original_text")))
    assert {(r["handle"], r["translated_text"]) for r in back.collect()} == {("40", "tAAABBB\ntCCC"), ("41", "tonly chunk")}


def write(folder, name="d.dxf", rows=None, newline="\r\n", encoding="utf-8"):
    lines = [x for c, v in rows or drawing() for x in (f"{c:>3}", v)]
    (folder / name).write_bytes((newline.join(lines) + newline).encode(encoding))
    return lines


def test_files(spark, tmp_path):
    lines = write(tmp_path)
    write(tmp_path, "gbk.dxf", [(0, "TEXT"), (5, "1"), (1, "钢梁")], "\n", "gbk")
    (tmp_path / "utf16.dxf").write_bytes("  0\nTEXT\n  1\n梁\nodd".encode("utf-16"))
    df = dxf.read_lines(spark, str(tmp_path))
    assert [r["text"] for r in df.where("path like '%/d.dxf'").orderBy("line_no").collect()] == lines
    values = {r["value"] for r in dxf.pairs_of(df).where("code = 1").collect()}
    assert {"钢梁", "梁", "Steel beam"} <= values
    check = {r["path"].split("/")[-1]: (r["even"], r["bad_codes"]) for r in dxf.structure_check(df).collect()}
    assert check == {"d.dxf": (True, 0), "gbk.dxf": (True, 0), "utf16.dxf": (False, 1)}
    dxf.register(spark)
    assert spark.read.format("dxf").load(str(tmp_path)).where("code = 1 and value = '钢梁'").count() == 1
    (tmp_path / "bin.dxf").write_bytes(b"AC1032\x00\x01")
    with pytest.raises(Exception, match="binary drawing"):
        dxf.read_lines(spark, str(tmp_path)).count()


def test_identity_and_translation(spark, tmp_path):
    write(tmp_path)
    session = pipeline.Session(spark, str(tmp_path))
    lines = session.lines
    same = session.items.where("entity_type <> 'MText'").withColumn("translated_text", F.col("raw_original_text"))
    back, _ = W.write_back(lines, same)
    key = lambda df: [(r["line_no"], r["text"]) for r in df.orderBy("line_no").collect()]
    assert key(back) == key(lines)
    out = tmp_path / "out"
    summary = session.translate_drawing(pipeline.E.make_engine("marker"), "en", "zh", str(out)).first()
    assert (summary["ok"], summary["skipped"], summary["warnings"]) == (8, 1, 1)
    again = pipeline.Session(spark, str(out))
    got = {r["handle"]: r["original_text"] for r in again.items.collect()}
    assert got["30"] == "[zh] Steel beam" and got["32"] == "1500" and got["1A6::R0::C0"] == "[zh] Header A" and got["40"].startswith("[zh] AAABBB")
    assert dxf.structure_check(again.lines).first()["even"]
    edits = spark.createDataFrame([(session.items.first()["path"], "30", None, "梁", 1)], "path string, id string, original string, translated string, seq int")
    assert session.write_translation(edits, str(tmp_path / "out2")).first()["ok"] == 1


def test_layout(spark):
    p = pairs(spark, *drawing())
    rows = lambda **t: spark.createDataFrame([("d", "MText" if h == "h40" else "Text", h[1:], v) for h, v in t.items()], "path string, entity_type string, handle string, text string")
    got = {r["key"]: r for r in W.layout(p, rows(h30="ab", h40="x"), rows(h30="abcd", h40="你" * 30)).collect()}
    assert got["30"]["scale"] == 0.65 and got["30"]["height"] == "1.625000" and got["40"]["scale"] == round(50.5 / 60, 6)


def test_dispatch(spark, tmp_path):
    write(tmp_path)
    session = pipeline.Session(spark, str(tmp_path))
    assert pipeline.dispatch(session, {"command": "translate_text", "args": {"text": "a"}, "id": 7}) == {"success": True, "data": "[en] a", "error": None, "id": 7}
    assert "KeyError" in pipeline.dispatch(session, {"command": "nope"})["error"]
    assert pipeline.dispatch(session, {"command": "read_entities"})["data"].count() == 10
    assert "marker" in pipeline.dispatch(session, {"command": "list_engines"})["data"]


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([("a/d.dxf", 2, "@_1_&f0", "钢 <梁> & \x01", None, ""), ("a/d.dxf", 3, "@_2_&f0,@_3_&f0", " B ", "b", "2;3")], "path string, row_no int, id string, source string, translation string, all_handles string")
    sheet.write_workbooks(rows, str(tmp_path / "x"))
    got = [tuple(r)[1:] for r in sheet.read_workbooks(spark, str(tmp_path / "x")).orderBy("row_no").collect()]
    assert got == [(2, "@_1_&f0", "钢 <梁> & ", "", "", "rich"), (3, "@_2_&f0,@_3_&f0", " B ", "b", "2;3", "rich")]
    sheet.write_workbooks(rows, str(tmp_path / "y"), legacy=True)
    assert [(r["source"], r["format"]) for r in sheet.read_workbooks(spark, str(tmp_path / "y")).orderBy("row_no").collect()] == [("钢 <梁> & ", "legacy"), (" B ", "legacy")]
    sheet.write_csv(rows, str(tmp_path / "c"))
    assert sheet.read_csv(spark, str(tmp_path / "c")).count() == 2


def test_glossary_and_settings(spark, tmp_path):
    assert glossary.read_glossary(spark, str(tmp_path / "none.json")).count() == 0
    terms = spark.createDataFrame([("a", "b", "en", "zh", False, False, None, None)], glossary.SCHEMA)
    glossary.write_glossary(terms, str(tmp_path / "g"))
    assert glossary.read_glossary(spark, str(tmp_path / "g")).collect() == terms.collect()
    (tmp_path / "s.json").write_text('{"tables": false, "clean": {"target_lang": "ja"}, "other": 1}')
    got = glossary.load_settings(str(tmp_path / "s.json"))
    assert not got.tables and got.clean.target_lang == "ja"
    glossary.save_settings(got, str(tmp_path / "t.json"))
    assert glossary.load_settings(str(tmp_path / "t.json")) == got
    assert glossary.load_settings(str(tmp_path / "missing.json")) == ExtractConfig()
