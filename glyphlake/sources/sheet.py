"""Review sheets as workbooks (xlsx) and text tables (csv).

A workbook is a zip of XML parts; what a review sheet needs of it -- one sheet,
inline or shared strings, a hidden column -- is read and written here with the
standard library.  Many workbooks are read in parallel, one task each.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources.dxf import read_root

# Headers of the two layouts, the namespace of sheets.
RICH_HEADER = ("id", "原文", "翻译", "全部句柄")
LEGACY_HEADER = ("原文", "译文")
RICH_FIRST = ("id", "handle")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SCHEMA = "path string, row_no int, id string, source string, translation string, all_handles string, format string"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> list[tuple[int, list[str | None]]]:
    """``(row number, cells)`` of the first sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for k, row in enumerate(ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"), 1):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(f"{_NS}c")):
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                cells[_column(c.get("r")) if c.get("r") else i] = text
            out.append((int(row.get("r") or k), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
        return out


def is_rich(header: list[str | None]) -> bool:
    """Whether the first header cell names an id or a handle."""
    return bool(header) and (header[0] or "").strip().lower() in RICH_FIRST


def sheet_records(data: bytes) -> Iterator[tuple[int, str | None, str | None, str | None, str | None, str]]:
    """``(row_no, id, source, translation, all_handles, format)`` of the rows under the header."""
    rows = workbook_rows(data)
    rich = is_rich(rows[0][1]) if rows else False
    for no, cells in rows[1:]:
        a, b, c, d = (list(cells) + [None] * 4)[:4]
        yield (no, a, b, c, d, "rich") if rich else (no, None, a, b, None, "legacy")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All review workbooks under a path, as sheet rows with their layout."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                found = pd.DataFrame(list(sheet_records(data)), columns=["row_no", "id", "source", "translation", "all_handles", "format"])
                yield found.assign(path=name).astype({"row_no": "int32"})[["path", "row_no", "id", "source", "translation", "all_handles", "format"]]

    return files.mapInPandas(rows, SCHEMA)


def workbook(header: tuple[str, ...], rows: list[list[str | None]], hidden: int | None = None) -> bytes:
    """A workbook of one sheet with inline strings; column ``hidden`` (from 0) is not shown."""

    def cell(i: int, r: int, v: str | None) -> str:
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v or "")
        return f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(i, r, v) for i, v in enumerate(values)) + "</row>" for r, values in enumerate([list(header), *rows], 1))
    cols = f'<cols><col min="{hidden + 1}" max="{hidden + 1}" width="9" hidden="1" customWidth="1"/></cols>' if hidden is not None else ""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Texts" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}">{cols}<sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def write_workbooks(sheet: DataFrame, folder: str, legacy: bool = False, root: str | None = None) -> None:
    """One workbook for each path of the sheet rows, named by its whole path from ``root`` (see ``read_root``) and ``.xlsx``; a path's rows are one task."""
    base = read_root(sheet, root)
    columns = ["source", "translation"] if legacy else ["id", "source", "translation", "all_handles"]

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        name = os.path.join(folder, pdf["path"].iloc[0][len(base) :].lstrip("/") + ".xlsx")
        os.makedirs(os.path.dirname(name), exist_ok=True)
        rows = [[None if pd.isna(v) else str(v) for v in r] for r in pdf[columns].itertuples(index=False)]
        data = workbook(LEGACY_HEADER if legacy else RICH_HEADER, rows, None if legacy else 3)
        with open(name, "wb") as f:
            f.write(data)
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "rows": [len(pdf)]})

    os.makedirs(folder, exist_ok=True)
    sheet.select("path", "row_no", *columns).groupBy("path").applyInPandas(save, "path string, rows long").collect()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rich sheet rows of csv files with the header ``path,row_no,id,source,translation,all_handles``."""
    return spark.read.schema("path string, row_no int, id string, source string, translation string, all_handles string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(sheet: DataFrame, path: str) -> None:
    sheet.select("path", "row_no", "id", "source", "translation", "all_handles").repartition("path").sortWithinPartitions("path", "row_no").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sheet_formats(rows: DataFrame) -> DataFrame:
    """``path, format`` of read workbooks."""
    return rows.groupBy("path").agg(F.min("format").alias("format"))
