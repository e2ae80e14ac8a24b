"""``.xlsx`` workbooks as cells, read with the standard library.

A workbook is a zip archive of XML parts.  Reading goes in two steps, so that a large
sheet is the work of several tasks and none holds more than the packed file and a
piece of XML:

1. One task per file inflates its parts as streams and cuts them into pieces of about
   ``PIECE_BYTES`` at the ends of rows, or of shared strings.  A piece knows the row (or
   string) that it starts at.
2. Pieces are dealt out and parsed.  Cells that refer to shared strings get their texts
   by a join on file and number; no task holds a file's strings.

Files come through Spark, so any store that it reads will do.  What cannot be read is
isolated: a broken file or part gives a row of ``failures`` and costs no other part, a
broken cell costs itself alone (files of no bytes give nothing, as Spark passes them over).  Rows and cells without a reference stand behind
those before them, as the format says.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.staging import staged
from ledgerloom.sources.cells import SCHEMA

PIECE_BYTES = 4 << 20
_BLOCK = 1 << 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that dates and amounts use.
_BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}


def _column(letters: str) -> int:
    n = 0
    for letter in letters:
        n = 26 * n + ord(letter) - 64
    return n - 1


def column_letters(index: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _blocks(part: IO[bytes], size: int) -> Iterator[bytes]:
    """A part as UTF-8, block by block."""
    block = part.read(size)
    wide = codecs.getincrementaldecoder("utf-16")() if block[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else None
    while block:
        yield wide.decode(block).encode() if wide else block
        block = part.read(size)


def _pieces(part: IO[bytes], root: str, item: str, number: Callable[[bytes, int], int], piece_bytes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``(first, start tag of the root, content)``: the part's items, whole, in pieces. ``number``: of the next item, given the items of a piece and the number of its first."""
    start = re.compile(rb"<(?:[\w.-]+:)?" + root.encode() + rb"\b[^>]*>")
    end = re.compile(rb"</(?:[\w.-]+:)?" + item.encode() + rb"\s*>|<(?:[\w.-]+:)?" + item.encode() + rb"\b[^>]*/>")
    opening = re.compile(rb"<(?:[\w.-]+:)?" + item.encode() + rb"\b")
    head, held, first = None, b"", 0
    for block in _blocks(part, min(_BLOCK, max(256, piece_bytes))):
        held += block
        if head is None:
            found = start.search(held)
            if not found:
                continue
            head, held = found[0], held[found.end() :]
        if len(held) < piece_bytes:
            continue
        last = None
        for last in end.finditer(held):
            pass
        if last:
            yield first, head, held[: last.end()]
            first, held = number(held[: last.end()], first), held[last.end() :]
    if head is None:
        raise ValueError(f"no {root} in the part")
    begins = opening.search(held)
    if begins:
        last = None
        for last in end.finditer(held, begins.start()):
            pass
        if last:
            yield first, head, held[: last.end()]
        if opening.search(held, last.end() if last else 0):
            raise ValueError(f"the part ends within a {item}")


_ROW = re.compile(rb"<(?:[\w.-]+:)?row\b([^>]*)>")
_ROW_NUMBER = re.compile(rb"""\sr\s*=\s*["']\s*(\d+)""")
_STRING = re.compile(rb"<(?:[\w.-]+:)?si\b")


def _rows_before(piece: bytes, first: int) -> int:
    for row in _ROW.finditer(piece):
        given = _ROW_NUMBER.search(row[1])
        first = int(given[1]) if given else first + 1
    return first


def _strings_before(piece: bytes, first: int) -> int:
    return first + len(_STRING.findall(piece))


def _items(head: bytes, content: bytes, item: str) -> Iterator[ElementTree.Element]:
    """The elements of a piece, under its root's names. What stands before the first of them does not matter."""
    content = content[re.search(rb"<(?:[\w.-]+:)?" + item.encode() + rb"\b", content).start() :]
    name = re.match(rb"<([^\s/>]+)", head)[1]
    yield from ElementTree.fromstring(head + content + b"</" + name + b">").iterfind(f"{_MAIN}{item}")


def _text(element: ElementTree.Element) -> str:
    """The text of a string, without its reading aids."""
    return "".join(t.text or "" for x in element for t in ([x] if x.tag == f"{_MAIN}t" else x.iterfind(f"{_MAIN}t") if x.tag == f"{_MAIN}r" else ()))


def _formats(book: zipfile.ZipFile) -> list[str | None]:
    if "xl/styles.xml" not in book.namelist():
        return []
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iterfind(f"{_MAIN}numFmts/{_MAIN}numFmt")}
    return [(own | _BUILT_IN).get(int(x.get("numFmtId", 0))) for x in styles.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")]


_PIECE = "kind string, sheet string, first long, head binary, content binary, formats array<string>, error string"


def pieces_of(content: bytes, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple]:
    """The pieces of a workbook, as ``_PIECE`` has them: of kind ``strings``, ``rows`` or ``failure``."""

    def failure(sheet: str | None, error: Exception) -> tuple:
        return ("failure", sheet, None, None, None, None, repr(error))

    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), s.get(_REL)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(f"{_MAIN}sheets/{_MAIN}sheet")]
    except Exception as error:  # noqa: BLE001  whatever is wrong with one file must not stop the others
        yield failure(None, error)
        return
    formats: list[str | None] = []
    try:
        formats = _formats(book)
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for piece in _pieces(part, "sst", "si", _strings_before, piece_bytes):
                    yield ("strings", None, *piece, None, None)
    except Exception as error:  # noqa: BLE001
        yield failure(None, error)
    for name, relation in sheets:
        try:
            target = targets[relation]
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                for piece in _pieces(part, "worksheet", "row", _rows_before, piece_bytes):
                    yield ("rows", name, *piece, formats, None)
        except Exception as error:  # noqa: BLE001
            yield failure(name, error)


_CELL = f"{SCHEMA}, string_ix long"


def cells_of(sheet: str, first: int, head: bytes, content: bytes, formats: list[str | None]) -> Iterator[tuple]:
    """``(sheet, row_ix, col_ix, s, n, fmt, string_ix)`` of every filled cell of a piece. A cell that cannot be read gives its error (in ``s``, under row -1)."""
    row_number = first
    for row in _items(head, content, "row"):
        given = row.get("r")
        row_number = int(given) if given and given.strip().isdecimal() else row_number + 1
        column = -1
        for cell in row.iterfind(f"{_MAIN}c"):
            place = re.match(r"\s*([A-Z]+)", cell.get("r") or "")
            column = _column(place[1]) if place else column + 1
            try:
                kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                inline = cell.find(f"{_MAIN}is")
                text = _text(inline) if kind == "inlineStr" and inline is not None else value.text if value is not None else None
                if not text:
                    continue
                style = int(cell.get("s", 0))
                fmt = formats[style] if 0 <= style < len(formats) else None
                number = float(text) if kind == "n" else None
                string = int(text) if kind == "s" else None
            except ValueError as error:
                yield sheet, -1, -1, f"{column_letters(column)}{row_number}: {error!r}", None, None, None
                continue
            yield sheet, row_number - 1, column, None if kind == "s" else text, number, fmt, string


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def workbooks(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Cells of all workbooks that ``path`` matches, with the file's ``path``. ``failures`` tells them from the rows that name what could not be read; those have no sheet."""
    piece, cell, string = f"path string, {_PIECE}", f"path string, {_CELL}", "path string, string_ix long, text string, error string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in pieces_of(content.as_py(), piece_bytes):
                    yield _batch([(name, *row)], piece)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                try:
                    rows.extend((row["path"], *c) for c in cells_of(row["sheet"], row["first"], row["head"], row["content"], row["formats"]))
                except Exception as error:  # noqa: BLE001
                    rows.append((row["path"], row["sheet"], -1, -1, repr(error), None, None, None))
                yield _batch(rows, cell)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                try:
                    rows.extend((row["path"], row["first"] + n, _text(si), None) for n, si in enumerate(_items(row["head"], row["content"], "si")))
                except Exception as error:  # noqa: BLE001
                    rows.append((row["path"], None, None, repr(error)))
                yield _batch(rows, string)

    pieces = staged(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, piece), "workbook-pieces")
    dealt = pieces.filter("kind <> 'failure'").repartition("path", "kind", "sheet", "first")
    read = staged(dealt.filter("kind = 'rows'").mapInArrow(parsed, cell), "workbook-cells")
    strings = staged(dealt.filter("kind = 'strings'").mapInArrow(texts, string), "workbook-strings")
    plain = read.filter("row_ix >= 0 and string_ix is null").drop("string_ix")
    refers = read.filter("row_ix >= 0 and string_ix is not null")
    found = refers.join(strings.filter("error is null").drop("error"), ["path", "string_ix"], "left")
    named = found.filter("text <> ''").select("path", "sheet", "row_ix", "col_ix", F.col("text").alias("s"), "n", "fmt")

    def failed(rows: DataFrame, sheet: Column, error: Column) -> DataFrame:
        """Rows of ``failures`` among cells: no sheet (so nothing takes them for cells), row -1, the error, and the sheet's name as format."""
        none = F.lit(None)
        return rows.select("path", none.cast("string").alias("sheet"), F.lit(-1).cast("long").alias("row_ix"), F.lit(-1).alias("col_ix"), error.alias("s"), none.cast("double").alias("n"), sheet.alias("fmt"))

    lost = found.filter("text is null").groupBy("path", "sheet").agg(F.min("string_ix").alias("ix"))
    bad = failed(pieces.filter("kind = 'failure'"), F.col("sheet"), F.col("error"))
    bad = bad.unionAll(failed(read.filter("row_ix < 0"), F.col("sheet"), F.col("s"))).unionAll(failed(strings.filter("error is not null"), F.lit(None).cast("string"), F.col("error")))
    bad = bad.unionAll(failed(lost, F.col("sheet"), F.concat(F.lit("no shared string "), F.col("ix").cast("string"))))
    return plain.unionAll(named).unionAll(bad)


def failures(cells: DataFrame) -> DataFrame:
    """``path, sheet, error`` of what ``workbooks`` could not read; without a sheet for a whole file or its strings."""
    return cells.filter("row_ix < 0").select("path", F.col("fmt").alias("sheet"), F.col("s").alias("error"))
