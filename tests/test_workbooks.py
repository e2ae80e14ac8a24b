"""Workbooks in pieces: large sheets, odd but legal files, and what cannot be read."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import recognition
from ledgerloom.sources import workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:x14ac="http://schemas.microsoft.com/office/spreadsheetml/2009/9/ac"'


def write_book(path, sheets, strings=None, styles=True, missing=()):
    """``sheets``: the rows of each sheet as XML, or a whole part."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{''.join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))}</sheets></workbook>")
        relations = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{relations}</Relationships>')
        if strings is not None:
            book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        if styles:
            book.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            if i not in missing:
                part = rows if not isinstance(rows, str) or rows.startswith("<?xml") else f"<worksheet {MAIN}><cols><col min='1' max='2'/></cols><sheetData>{rows}</sheetData><rowBreaks count='1'/></worksheet>"
                book.writestr(f"xl/worksheets/sheet{i}.xml", part)


def read(spark, folder, **options):
    cells = workbook.workbooks(spark, f"file://{folder}/*.xlsx", **options)
    names = F.element_at(F.split("path", "/"), -1)
    got = {(r[0], r["sheet"], r["row_ix"], r["col_ix"]): (r["s"], r["n"], r["fmt"]) for r in cells.filter("row_ix >= 0").select(names, "*").collect()}
    bad = {(r[0], r["sheet"]): r["error"] for r in workbook.failures(cells).select(names, "*").collect()}
    return got, bad


@pytest.mark.parametrize("piece_bytes", [1, 300, 1 << 20])
def test_pieces_of_a_sheet_give_what_the_whole_gives(spark, tmp_path, piece_bytes):
    rng = random.Random(3)
    strings = [f"<t>s{i} &amp; &lt;row&gt;</t>" if i % 3 else f"<r><t>a</t></r><r><t xml:space='preserve'> b{i}</t></r><rPh sb='0' eb='1'><t>reading</t></rPh>" for i in range(40)]
    rows, want = [], {}
    at = 0
    for i in range(120):
        given = rng.random() < 0.7
        at = at + rng.randint(1, 3) if given else at + 1
        cells, column = [], -1
        for _ in range(rng.randint(0, 4)):
            referred = rng.random() < 0.6
            column = column + rng.randint(1, 30) if referred else column + 1
            r = f' r="{workbook.column_letters(column)}{at}"' if referred else ""
            kind = rng.choice("nsbi")
            if kind == "n":
                cells.append(f'<c{r} s="1"><v>{i}.5</v></c>')
                want["One", at - 1, column] = (f"{i}.5", i + 0.5, "dd/mm")
            elif kind == "s":
                k = rng.randrange(40)
                cells.append(f'<c{r} t="s"><v>{k}</v></c>')
                want["One", at - 1, column] = (f"s{k} & <row>" if k % 3 else f"a b{k}", None, None)
            elif kind == "b":
                cells.append(f'<c{r} t="b"><v>1</v></c>')
                want["One", at - 1, column] = ("1", None, None)
            else:
                cells.append(f'<c{r} t="inlineStr"><is><t>in {i}</t></is></c><c/>')
                want["One", at - 1, column] = (f"in {i}", None, None)
                column += 1
        own = f' r="{at}" x14ac:dyDescent="0.2"' if given else ""
        rows.append(f"<row{own}>{''.join(cells)}</row>" if cells else f"<row{own}/>")
    write_book(tmp_path / "a.xlsx", {"One": "".join(rows), "Empty": ""}, strings)
    got, bad = read(spark, tmp_path, piece_bytes=piece_bytes)
    assert {k[1:]: v for k, v in got.items()} == want and bad == {}


def test_one_broken_sheet_or_cell_costs_no_other(spark, tmp_path):
    good = '<row><c><v>1</v></c><c t="s"><v>0</v></c></row>'
    write_book(tmp_path / "cells.xlsx", {"Good": good, "Number": '<row r="3"><c r="A3"><v>x1</v></c><c r="B3"><v>7</v></c></row>', "Index": '<row><c t="s"><v>9</v></c><c><v>8</v></c></row>'}, ["<t>zero</t>"])
    write_book(tmp_path / "parts.xlsx", {"Good": good, "Gone": "", "Cut": f"<?xml version='1.0'?><worksheet {MAIN}><sheetData><row><c><v>1</v></c></row><row><c>", "Tags": "<row><c><v>1</c></row>", "None": "<?xml version='1.0'?><other/>"}, ["<t>zero</t>"], missing=(1,))
    write_book(tmp_path / "texts.xlsx", {"Good": good}, ["<t>zero</x>"])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    got, bad = read(spark, tmp_path)
    assert {k: v[0] for k, v in got.items()} == {
        ("cells.xlsx", "Good", 0, 0): "1", ("cells.xlsx", "Good", 0, 1): "zero", ("cells.xlsx", "Number", 2, 1): "7", ("cells.xlsx", "Index", 0, 1): "8",
        ("parts.xlsx", "Good", 0, 0): "1", ("parts.xlsx", "Good", 0, 1): "zero", ("parts.xlsx", "Cut", 0, 0): "1", ("texts.xlsx", "Good", 0, 0): "1",
    }
    assert set(bad) == {("cells.xlsx", "Number"), ("cells.xlsx", "Index"), ("parts.xlsx", "Gone"), ("parts.xlsx", "Cut"), ("parts.xlsx", "Tags"), ("parts.xlsx", "None"), ("texts.xlsx", None), ("texts.xlsx", "Good"), ("broken.xlsx", None)}
    assert "A3" in bad["cells.xlsx", "Number"] and "no shared string 9" in bad["cells.xlsx", "Index"]


def test_other_prefixes_and_encodings(spark, tmp_path):
    prefixed = "<?xml version='1.0'?><x:worksheet xmlns:x='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><x:sheetData><x:row><x:c><x:v>5</x:v></x:c></x:row></x:sheetData></x:worksheet>"
    write_book(tmp_path / "a.xlsx", {"Prefix": prefixed, "Wide": "<?xml version='1.0' encoding='UTF-16'?><worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData><row><c t='str'><v>日本</v></c></row></sheetData></worksheet>".encode("utf-16")}, styles=False)
    got, bad = read(spark, tmp_path, piece_bytes=1)
    assert {k[1]: v[0] for k, v in got.items()} == {"Prefix": "5", "Wide": "日本"} and bad == {}


def test_a_large_sheet_is_the_work_of_several_tasks(spark, tmp_path):
    n = 30_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "20k")  # of packed pieces; usually 1 MB
    write_book(tmp_path / "big.xlsx", {"Big": "<row><c t='str'><v>Name</v></c><c t='str'><v>Amount</v></c></row>" + "".join(f"<row><c t='s'><v>{i % 1000}</v></c><c><v>{i}</v></c></row>" for i in range(n))}, [f"<t>name {i}</t>" for i in range(1000)])
    cells = workbook.workbooks(spark, f"file://{tmp_path}/*.xlsx", piece_bytes=100_000)
    assert cells.agg(F.count("*"), F.sum("n"), F.max("row_ix"), F.countDistinct("s")).first()[:3] == (2 * n + 2, n * (n - 1) / 2, n)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len([f for f in cells.inputFiles() if "workbook-cells" in f]) > 1  # a file for each task that wrote
    largest = max(len(piece[4]) for piece in workbook.pieces_of((tmp_path / "big.xlsx").read_bytes(), 100_000))
    assert largest <= 200_000


def test_failures_do_not_disturb_recognition(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"S": "<row><c t='str'><v>Name</v></c><c t='str'><v>Rate</v></c></row><row><c t='str'><v>x</v></c><c><v>bad</v></c></row><row><c t='str'><v>y</v></c><c><v>5</v></c></row>"})
    cells = workbook.workbooks(spark, f"file://{tmp_path}/*.xlsx")
    assert workbook.failures(cells).count() == 1
    assert [(c.header, c.filled) for c in recognition.read_sheets(cells)["S"]] == [("Name", 2), ("Rate", 1)]
