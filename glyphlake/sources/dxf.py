"""Tagged-line drawing files as tables.

A file is read whole by one task, so that its encoding can be told and its line
ends kept; many files are read in parallel.  ``read_lines`` gives the lines,
``pairs_of`` the code-value pairs of any table of lines.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Byte order marks, the fallback page, and what binary files start with.
BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
FALLBACK = "gb18030"
BINARY_DXF = b"AutoCAD Binary DXF\r\n\x1a\x00"
DWG = re.compile(rb"^AC1[0-9]{3}|^AC[0-9]{4}")

LINE, BYTE_LINE = re.compile(r"\r\n|\n|\r"), re.compile(rb"\r\n|\n|\r")
#: How a line stands in its file: the encoding, whether the file has a byte order mark, the line end, and the line's bytes if its text does not encode to them.
FORM = ("encoding", "bom", "line_end", "raw")
LINES_SCHEMA = "path string, line_no int, text string, encoding string, bom boolean, line_end string, raw binary"
#: Names without a mark of their own, and the marks.
PLAIN_NAMES = {"utf-8-sig": "utf-8", "utf-16": "utf-16-le"}
MARKS = {PLAIN_NAMES.get(name, name): bom for bom, name in BOMS}


def is_binary(head: bytes) -> bool:
    """Whether a file is a binary drawing, by its first 22 bytes."""
    return head.startswith(BINARY_DXF[:18]) or bool(DWG.match(head[:6]))


def detect_encoding(data: bytes, fallback: str = FALLBACK) -> str:
    """By byte order mark, else UTF-8 if the sample is valid, else the fallback page."""
    for bom, name in BOMS:
        if data.startswith(bom):
            return name
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return fallback
    return "utf-8"


def decode(data: bytes, fallback: str = FALLBACK) -> str:
    name = detect_encoding(data, fallback)
    skip = 2 if name.startswith("utf-16") else 0
    return data[skip:].decode(name, errors="replace")


def split_lines(text: str) -> list[str]:
    """The lines of a file; one empty line after the last line end is dropped."""
    lines = LINE.split(text)
    return lines[:-1] if lines and lines[-1] == "" else lines


def formed_lines(data: bytes, fallback: str = FALLBACK) -> pd.DataFrame:
    """``text, encoding, bom, line_end, raw`` of the lines of a file, from which ``file_bytes`` makes the same bytes."""
    name = detect_encoding(data, fallback)
    name = PLAIN_NAMES.get(name, name)
    bom = data.startswith(MARKS[name]) if name in MARKS else False
    body = data[len(MARKS[name]) if bom else 0 :]
    try:
        whole = body.decode(name)
        exact = whole.encode(name) == body
    except UnicodeError:
        exact = False
    if exact:
        texts, ends = LINE.split(whole), [*LINE.findall(whole), ""]
        raws: list[bytes | None] = [None] * len(texts)
    else:
        if name.startswith("utf-16"):
            even = len(body) // 2 * 2
            units = body[:even].decode(name, "surrogatepass")
            parts, ends = [x.encode(name, "surrogatepass") for x in LINE.split(units)], [*LINE.findall(units), ""]
            parts[-1] += body[even:]
        else:
            # No byte of a line end is a part of a longer character in these encodings.
            parts, ends = BYTE_LINE.split(body), [x.decode("ascii") for x in BYTE_LINE.findall(body)] + [""]
        texts = [x.decode(name, "replace") for x in parts]
        raws = [None if t.encode(name, "replace") == x else x for t, x in zip(texts, parts)]
    if texts[-1] == "":
        texts, ends, raws = texts[:-1], ends[:-1], raws[:-1]
    return pd.DataFrame({"text": texts, "encoding": name, "bom": bom, "line_end": ends, "raw": pd.Series(raws, dtype=object)})


def _escaped(e: UnicodeError) -> tuple[str, int]:
    r"""Characters that an encoding lacks as ``\U+XXXX``, as drawings write them."""
    units = e.object[e.start : e.end].encode("utf-16-be", "surrogatepass")
    codes = [int.from_bytes(units[i : i + 2], "big") for i in range(0, len(units), 2)]
    return "".join(f"\\U+{c:08X}" if 0xD800 <= c < 0xE000 else f"\\U+{c:04X}" for c in codes), e.end


def file_bytes(lines: pd.DataFrame) -> bytes:
    """The bytes of a file from its lines in order, with the columns of ``formed_lines``."""
    codecs.register_error("drawing", _escaped)
    name, bom = lines["encoding"].iloc[0], lines["bom"].iloc[0]
    head = MARKS[name] if bom else b""
    if lines["raw"].isna().all():
        return head + "".join(lines["text"] + lines["line_end"]).encode(name, "drawing")
    rows = zip(lines["text"], lines["line_end"], lines["raw"])
    return head + b"".join((t.encode(name, "drawing") if raw is None else bytes(raw)) + end.encode(name) for t, end, raw in rows)


def read_lines(spark: SparkSession, path: str, fallback: str = FALLBACK) -> DataFrame:
    """``path, line_no, text`` of the drawing files under a path, and their ``FORM``; binary drawings are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][xX][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                if is_binary(data[:22]):
                    raise ValueError(f"{name} is a binary drawing; convert it to text first")
                found = formed_lines(data, fallback)
                yield found.assign(path=name, line_no=range(len(found))).astype({"line_no": "int32"})[["path", "line_no", "text", *FORM]]

    return files.mapInPandas(lines, LINES_SCHEMA)


def pairs_of(lines: DataFrame) -> DataFrame:
    """``path, pair_idx, code, value, value_line``: two lines a pair; a pair whose first line is no integer is skipped whole.

    ``value_line`` is the number of the value's line, from 0.  A last line
    without partner is dropped.
    """
    by = F.expr("line_no div 2").cast("int")
    both = lines.groupBy("path", by.alias("pair_idx")).agg(F.max(F.when(F.col("line_no") % 2 == 0, F.col("text"))).alias("code"), F.max(F.when(F.col("line_no") % 2 == 1, F.col("text"))).alias("value"), F.count(F.lit(1)).alias("n"))
    code = F.expr("try_cast(trim(code) as int)")
    return both.where("n = 2").select("path", "pair_idx", code.alias("code"), "value", (F.col("pair_idx") * 2 + 1).alias("value_line")).where("code is not null")


def structure_check(lines: DataFrame) -> DataFrame:
    """``path, lines, even, bad_codes``: files of whole pairs have an even count and only integers as codes."""
    integer = F.col("text").rlike(r"^\s*[+-]?[0-9]+\s*$")
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), (F.count(F.lit(1)) % 2 == 0).alias("even"), F.count_if((F.col("line_no") % 2 == 0) & ~integer).alias("bad_codes"))


def read_root(rows: DataFrame, root: str | None = None) -> str:
    """What to cut from each path of ``rows`` for its name under another folder: ``root`` if all lie in it, else the deepest folder that all share."""
    first, last = rows.agg(F.min("path"), F.max("path")).first()
    # All paths lie between the two in order, so what these share all share.
    shared = os.path.commonprefix([first or "", last or ""])
    shared = shared[: shared.rfind("/") + 1]
    if root is not None:
        scheme = re.match(r"file:(//)?(?=/)", shared)
        root = (scheme[0] if scheme else "") + os.path.abspath(re.sub(r"^file:(//)?(?=/)", "", root)).rstrip("/") + "/"
    return root if root is not None and shared.startswith(root) else shared


def write_lines(lines: DataFrame, folder: str, encodings: DataFrame | None = None, root: str | None = None) -> None:
    """Write each path's lines as one file under ``folder``, named by its path from ``root`` (see ``read_root``).

    Lines with ``FORM`` keep it.  For others ``encodings`` may give ``path,
    encoding, newline`` to keep; the default is UTF-8 and line feeds.  A path's
    lines are sorted inside its task.
    """
    base = read_root(lines, root)
    rows = lines.select("path", "line_no", "text", *FORM) if set(FORM) <= set(lines.columns) and encodings is None else lines.select("path", "line_no", "text")
    if encodings is not None:
        rows = rows.join(encodings.select("path", "encoding", "newline"), "path", "left")

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        path = pdf["path"].iloc[0]
        name = os.path.join(folder, path[len(base) :].lstrip("/"))
        if "raw" not in pdf:
            encoding, newline = (pdf[c].iloc[0] if c in pdf else None for c in ("encoding", "newline"))
            pdf = pdf.assign(encoding=PLAIN_NAMES.get(encoding, encoding) or "utf-8", bom=encoding == "utf-8-sig", line_end=newline or "\n", raw=None)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "wb") as f:
            f.write(file_bytes(pdf))
        return pd.DataFrame({"path": [path], "lines": [len(pdf)]})

    os.makedirs(folder, exist_ok=True)
    rows.groupBy("path").applyInPandas(save, "path string, lines long").collect()


class DxfDataSource(DataSource):
    """``spark.read.format("dxf").load(folder)``: the code-value pairs of the drawings, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return "path string, pair_idx int, code int, value string, value_line int"

    def reader(self, schema) -> DataSourceReader:
        return _DxfReader(self.options)


class _DxfReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.fallback = options.get("encoding", FALLBACK)

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.folder):
            return [InputPartition(self.folder)]
        found = [os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.lower().endswith(".dxf")]
        return [InputPartition(x) for x in sorted(found)]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            data = f.read()
        if is_binary(data[:22]):
            raise ValueError(f"{partition.value} is a binary drawing; convert it to text first")
        lines = split_lines(decode(data, self.fallback))
        for i in range(len(lines) // 2):
            code = lines[2 * i].strip()
            if re.fullmatch(r"[+-]?\d+", code):
                yield partition.value, i, int(code), lines[2 * i + 1], 2 * i + 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DxfDataSource)


def replace_spans(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines with spans replaced and numbered anew: ``path, line_no, text``, and the ``FORM`` if the lines have it.

    ``edits`` has ``path, first_line, last_line, new_lines``: the lines from the
    first to the last give way to an array of new ones.  Spans do not overlap.
    New lines have the form of the first and the line end of the last they replace.
    """
    form = FORM if set(FORM) <= set(lines.columns) else ()
    gone = edits.select("path", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    kept = lines.join(gone, ["path", "line_no"], "left_anti").select("path", "line_no", F.lit(0).alias("sub"), "text", *form)
    if form:
        first = lines.select("path", F.col("line_no").alias("first_line"), "encoding", "bom", F.col("line_end").alias("first_end"))
        last = lines.select("path", F.col("line_no").alias("last_line"), F.col("line_end").alias("last_end"))
        edits = edits.join(first, ["path", "first_line"]).join(last, ["path", "last_line"])
        inner = F.when(F.col("first_end") != "", F.col("first_end")).otherwise("\n")
        end = F.when(F.col("sub") == F.size("new_lines") - 1, F.col("last_end")).otherwise(inner)
        new = edits.select("*", F.posexplode("new_lines").alias("sub", "text")).select("path", F.col("first_line").alias("line_no"), "sub", "text", "encoding", "bom", end.alias("line_end"), F.lit(None).cast("binary").alias("raw"))
    else:
        new = edits.select("path", F.col("first_line").alias("line_no"), F.posexplode("new_lines").alias("sub", "text"))
    w = Window.partitionBy("path").orderBy("line_no", "sub")
    return kept.unionByName(new).select("path", (F.row_number().over(w) - 1).alias("line_no"), "text", *form)
