"""The files that the pipeline writes."""

import os

from glyphlake.operators.extract import ExtractConfig
from glyphlake.plans import pipeline
from glyphlake.sources import dxf, sheet


def drawing(folder, name, *rows, newline="\n"):
    os.makedirs((folder / name).parent, exist_ok=True)
    pairs = [(0, "SECTION"), (2, "ENTITIES"), *rows, (0, "ENDSEC"), (0, "EOF")]
    (folder / name).write_bytes("".join(f"{c:>3}{newline}{v}{newline}" for c, v in pairs).encode())


def written(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_same_names_in_folders(spark, tmp_path):
    for name in ("A/plan.dxf", "B/plan.dxf", "B/C/plan.dxf", "plan.DXF"):
        drawing(tmp_path / "in", name, (0, "TEXT"), (5, "30"), (1, f"Beam of {name}"))
    session = pipeline.Session(spark, str(tmp_path / "in"))
    done = session.translate_drawing(pipeline.E.make_engine("marker"), "en", "zh", str(tmp_path / "out"))
    got = written(tmp_path / "out")
    assert done.count() == 4 and set(got) == {"A/plan.dxf", "B/plan.dxf", "B/C/plan.dxf", "plan.DXF"}
    assert all(f"[zh] Beam of {name}" in data.decode() for name, data in got.items())
    one = pipeline.Session(spark, str(tmp_path / "in" / "A"))
    one.translate_drawing(pipeline.E.make_engine("marker"), "en", "zh", str(tmp_path / "one"))
    assert set(written(tmp_path / "one")) == {"plan.dxf"}


def test_same_names_of_workbooks(spark, tmp_path):
    paths = ("file:/in/A/plan.dxf", "file:/in/B/plan.dxf", "file:/in/B/plan.DXF", "file:/in/B/plan")
    rows = spark.createDataFrame([(p, 2, "@_1_&f0", p, None, "") for p in paths], "path string, row_no int, id string, source string, translation string, all_handles string")
    sheet.write_workbooks(rows, str(tmp_path / "x"))
    assert set(written(tmp_path / "x")) == {"A/plan.dxf.xlsx", "B/plan.dxf.xlsx", "B/plan.DXF.xlsx", "B/plan.xlsx"}
    assert {r["source"] for r in sheet.read_workbooks(spark, str(tmp_path / "x")).collect()} == set(paths)


FORMS = {
    "gb.dxf": "  0\nTEXT\n  5\n30\n  1\n钢梁 beam\n  0\nTEXT\n  1\n1500".encode("gb18030"),
    "wide.dxf": b"\xff\xfe" + "  0\r\nTEXT\r\n  5\r\n30\r\n  1\r\n钢梁 beam\r\n".encode("utf-16-le"),
    "big.dxf": b"\xfe\xff" + "  0\nTEXT\n  5\n30\n  1\n钢梁 beam\n".encode("utf-16-be"),
    "mark.dxf": b"\xef\xbb\xbf" + "  0\r\nTEXT\r\n  5\r\n30\r\n  1\r\n钢梁 beam".encode(),
    "mixed.dxf": b"999\r\n\x81\xff\x80 lost\n  0\rTEXT\r\n  5\n30\n  1\r\nbeam\r\n\n",
    "odd.dxf": b"\xff\xfe" + "999\n".encode("utf-16-le") + b"\x00\xd8" + "\n  0\nTEXT\n  5\n30\n  1\nbeam\n".encode("utf-16-le") + b"\x20",
}


def test_bytes_of_files():
    for name, data in FORMS.items():
        lines = dxf.formed_lines(data)
        assert dxf.file_bytes(lines) == data, name
        assert "\n".join(lines["text"]).rstrip("\n") == "\n".join(dxf.split_lines(dxf.decode(data))).rstrip("\n"), name
    latin = dxf.formed_lines("1\nDach für".encode("cp1252"), "cp1252")
    assert dxf.file_bytes(latin.assign(text=["1", "für 梁"])) == b"1\nf\xfcr \\U+6881"


def test_files_keep_their_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in FORMS.items():
        (tmp_path / "in" / name).write_bytes(data)
    session = pipeline.Session(spark, str(tmp_path / "in"))
    session.translate_drawing(pipeline.E.make_engine("marker"), "en", "zh", str(tmp_path / "out"))
    got = written(tmp_path / "out")
    assert set(got) == set(FORMS)
    for name, data in FORMS.items():
        code = {"gb.dxf": "gb18030", "wide.dxf": "utf-16-le", "odd.dxf": "utf-16-le", "big.dxf": "utf-16-be"}.get(name, "utf-8")
        old = ("beam" if name in ("mixed.dxf", "odd.dxf") else "钢梁 beam").encode(code)
        assert got[name] == data.replace(old, "[zh] ".encode(code) + old), name


def test_paragraphs_are_written(spark, tmp_path):
    drawing(tmp_path / "in", "d.dxf", (0, "MTEXT"), (5, "40"), (3, r"AAA\~x"), (1, r"BBB\P\P1500\P{\H2;CCC}"), (0, "TEXT"), (5, "30"), (1, "Beam"))
    session = pipeline.Session(spark, str(tmp_path / "in"), ExtractConfig(mtext_whole=False, mtext_paragraphs=True))
    done = session.translate_drawing(pipeline.E.make_engine("marker"), "en", "zh", str(tmp_path / "out")).first()
    assert (done["ok"], done["warnings"]) == (2, 0)
    lines = written(tmp_path / "out")["d.dxf"].decode().split("\n")
    # Each paragraph keeps its place, and the blank one stays.
    assert [x.split(r"\P") for x in lines if "AAA" in x][0][1:] == ["", "[zh] 1500", r"{\H2;[zh] CCC}"] and "[zh] Beam" in lines


def test_overflowing_texts_are_scaled(spark, tmp_path):
    texts = ((0, "TEXT"), (5, "30"), (40, "2.0"), (1, "Beams"), (0, "TEXT"), (5, "31"), (1, "no height"))
    drawing(tmp_path / "in", "d.dxf", *texts, (0, "MTEXT"), (5, "40"), (40, "2.0"), (41, "4.0"), (1, "Paragraph"))
    size = {}
    for fit in (True, False):
        session = pipeline.Session(spark, str(tmp_path / "in"), fit=fit)
        session.translate_drawing(pipeline.E.make_engine("marker"), "en", "zh", str(tmp_path / f"out{fit}"))
        lines = written(tmp_path / f"out{fit}")["d.dxf"].decode().split("\n")
        size[fit] = [(c.strip(), float(v)) for c, v in zip(lines[::2], lines[1::2]) if c.strip() in ("40", "41")]
    assert size[False] == [("40", 2.0), ("40", 2.0), ("41", 4.0)]
    assert [c for c, _ in size[True]] == ["40", "40", "41"] and size[True][0][1] == 1.3 and size[True][1][1] == 1.3 and size[True][2][1] != 4.0


def test_encoding_is_decided_by_the_whole_file():
    from glyphlake.sources import dxf

    data = b"0\nTEXT\n1\nplain\n" * 1_200_000 + "电气设计".encode("gb18030")
    assert len(data) > 16 * 1024 * 1024 and dxf.detect_encoding(data, "gb18030") == "gb18030"


def test_local_folder_is_for_local_sessions_only():
    from types import SimpleNamespace

    import pytest

    from glyphlake import runtime

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://h:7077"), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.ensure_checkpoint_dir(cluster)
