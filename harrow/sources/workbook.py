"""Styled spreadsheets (Office Open XML) written part by part: frozen coloured header, column widths, text kept as text.

Each part of at most ``rows`` rows is one file, so a table of any size becomes a folder of workbooks.  Cells are inline
strings or numbers; nothing is taken for a formula or a link.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 100_000
LONGEST_CELL = 32_767  # what the format allows

_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def letters(k: int) -> str:
    """Name of the column with index ``k`` from 0."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(at: str, value, style: int = 0) -> str:
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) < 1e15:
        return f'<c r="{at}" s="{style}"><v>{value}</v></c>'
    text = escape(_BAD.sub("", str(value))[:LONGEST_CELL])
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def workbook(names: list[str], rows: list[tuple], widths: dict[str, float] | None = None, colour: str = "FFDDEBF7") -> bytes:
    """One sheet of ``rows`` under a header of ``names``; ``widths`` in characters, 20 where nothing is said."""
    widths = widths or {}
    cols = "".join(f'<col min="{k}" max="{k}" width="{widths.get(n, 20)}" customWidth="1"/>' for k, n in enumerate(names, 1))
    head = "".join(_cell(f"{letters(k)}1", n, 1) for k, n in enumerate(names))
    body = "".join(f'<row r="{i}">' + "".join(_cell(f"{letters(k)}{i}", v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 2))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="r2" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
        f'<fill><patternFill patternType="solid"><fgColor rgb="{colour}"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="2"><xf xfId="0"/><xf xfId="0" fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}">{pane}<cols>{cols}</cols><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def cells(raw: bytes) -> list[list[str | None]]:
    """Rows of a workbook that this module wrote, the header first, as text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    n = sheet.count("<col ")
    out = []
    for row in re.findall(r'<row r="\d+">(.*?)</row>', sheet, re.S):
        line: list[str | None] = [None] * n
        for column, text in re.findall(r'<c r="([A-Z]+)\d+"[^>]*>(?:<v>|<is><t[^>]*>)(.*?)(?:</v>|</t></is>)</c>', row, re.S):
            k = 0
            for letter in column:
                k = k * 26 + ord(letter) - 64
            line[k - 1] = unescape(text)
        out.append(line)
    return out


def write(df: DataFrame, path: str, rows: int = ROWS, widths: dict[str, float] | None = None) -> DataFrame:
    """Workbooks under ``path``; returns ``file, n`` of those written.  Dates and lists are written as text."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "string")
    df = df.select(*(F.col(f"`{c}`") if t in plain else (F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")).alias(c) for c, t in df.dtypes))
    names = df.columns
    target = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def put(part: list[tuple]) -> pa.RecordBatch:
            system, at = fs.FileSystem.from_uri(target)
            system.create_dir(at, recursive=True)
            file = f"part-{task:05}-{number:03}.xlsx"
            with system.open_output_stream(f"{at}/{file}") as out:
                out.write(workbook(names, part, widths))
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(part)], pa.int64())], names=["file", "n"])

        for b in batches:
            held += list(zip(*(c.to_pylist() for c in b.columns)))
            while len(held) >= rows:
                yield put(held[:rows])
                held, number = held[rows:], number + 1
        if held:
            yield put(held)

    done = df.mapInArrow(run, "file string, n bigint").collect()  # a row for each file
    return df.sparkSession.createDataFrame([tuple(r) for r in done], "file string, n bigint")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the workbooks under ``path`` that this module wrote, all columns as text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no workbook")
    names = cells(bytes(first[0][0]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                found = cells(raw)[1:]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(len(names))], names=names)

    return files.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
