"""Recognition of sheets and columns, memory of answers, workbooks, refresh."""

from __future__ import annotations

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import memory, recognition
from ledgerloom.sources import cells, workbook
from ledgerloom.streaming.refresh import Refresh, keep_fresh, keep_slices_fresh, latest_slices, slices

IDS = ["07AAAPL0001Q1Z5", "27AAAPL0002Q1Z5", "29AAAPL0003Q1Z5"]
STATEMENT = [["GSTIN of Supplier", "Trade/Legal Name", "Invoice Number", "Invoice Date", "Taxable Value", "Rate", "Integrated Tax", "Central Tax", "State/UT Tax", "Place of Supply"]] + [
    [IDS[i], f"Name {i}", f"INV/{i}", f"2024-04-0{i + 1}", 1000.0 + i, 18, 180.0 + i, 0, 0, "07-Delhi"] for i in range(3)
]
REGISTER = [["Purchase register"], ["Date", "Particulars", "Voucher Type", "Voucher No.", "GSTIN/UIN", "TV", "IGST", "CGST", "SGST"]] + [
    [f"2024-04-0{i + 1}", f"Goods {i}", "Purchase", f"V{i}", IDS[i], 1000.0 + i, 180.0 + i, 0, 0] for i in range(3)
]
STAFF = [["Employee ID", "Employee Name", "Department", "Salary"], ["E1", "x", "d", 10], ["E2", "y", "d", 20]]


@pytest.fixture(scope="module")
def sheets(spark):
    return recognition.read_sheets(cells.from_grids(spark, {"a": STATEMENT, "b": REGISTER, "c": STAFF}))


def test_roles_columns_and_choice_of_sheets(sheets):
    maps = {name: recognition.identify_columns(columns) for name, columns in sheets.items()}
    roles = {name: recognition.recognize_role(m) for name, m in maps.items()}
    assert {name: r.kind for name, r in roles.items()} == {"a": "gstr2a", "b": "purchase_register", "c": "unknown"}
    assert recognition.pick_sheets(roles) == {"gstr2a": "a", "purchase_register": "b"}
    assert maps["b"].found["voucher_number"] == 3 and maps["b"].found["taxable_value"] == 5
    assert recognition.open_fields("gstr2a", maps["a"]) == []
    assert ("taxable_value", "required") in recognition.open_fields("gstr2a", maps["c"])


def test_sheet_names_do_not_matter(spark, sheets):
    again = recognition.read_sheets(cells.from_grids(spark, {"x": STATEMENT}))["x"]
    assert recognition.signature(again) == recognition.signature(sheets["a"])


def test_header_is_found_below_a_title(spark):
    found = {r["sheet"]: r["header_ix"] for r in cells.header_rows(cells.from_grids(spark, {"a": STATEMENT, "b": REGISTER, "n": [[1, 2], [3, 4]]})).collect()}
    assert found == {"a": 0, "b": 1, "n": -1}


def test_answers_are_remembered_per_client(spark, sheets, tmp_path):
    store = memory.Memory()
    store.answer("me", sheets["b"], "b", "cgst", 7)
    assert store.columns("me", sheets["b"]) == {"cgst": 7}
    assert store.columns("you", sheets["b"]) == {}
    assert store.columns("me", sheets["b"] + sheets["c"][1:2]) == {"cgst": 7}
    assert store.columns("me", sheets["c"]) == {}
    store.write(spark, str(tmp_path / "memory"))
    assert memory.Memory.read(spark, str(tmp_path / "memory")).records == store.records
    assert store.forget("me", recognition.signature(sheets["b"])[0]) and not store.records
    assert memory.pattern_key("cgst", ["CGST @9%", "cgst 9", "IGST"]) == "cgst::cgst 9|igst"
    assert memory.corroborated(["Input CGST", "CGST"], ["cgst"]) == ("exact", "CGST")


def test_answers_can_be_reviewed_and_changed(sheets):
    store, structure = memory.Memory(), recognition.signature(sheets["b"])[0]
    store.answer("me", sheets["b"], "b", "cgst", 7)
    store.answer("me", sheets["b"], "b", "igst", 6)
    assert {row[2] for row in store.learned("me")} == {"cgst", "igst"} and store.learned("you") == []
    assert "cgst" in store.set_answer("me", structure, "igst", None).label and store.columns("me", sheets["b"]) == {"cgst": 7}
    header = next(c.header for c in sheets["b"] if c.index == 6)
    store.set_answer("me", structure, "cgst", header)
    assert store.columns("me", sheets["b"]) == {"cgst": 6}
    with pytest.raises(ValueError):
        store.set_answer("me", structure, "cgst", " ")
    assert store.set_answer("me", structure, "cgst", None) is None and not store.records
    assert store.set_answer("me", structure, "cgst", "x") is None and store.relabel("me", structure, "x") is None


def test_labels_come_from_rules_then_the_client_then_all_clients(sheets):
    own, shared, columns = memory.Memory(), memory.Patterns(), sheets["b"]
    label = lambda client, kind="unknown", tier=shared: memory.sheet_label(own, client, columns, kind, tier)
    assert label("me", "payroll") == memory.SheetLabel("classified", "payroll") and label("me").status == "needs_input"
    record = memory.remember_label(own, "me", columns, "b", " Purchases ", shared)
    assert label("me") == memory.SheetLabel("remembered", "Purchases", "exact")
    assert memory.sheet_label(own, "me", [*columns, sheets["c"][1]], "unknown").via == "fuzzy"
    assert label("you") == (memory.SheetLabel("remembered", "Purchases", "shared") if recognition.shareable(columns) else memory.SheetLabel("needs_input"))
    assert own.relabel("me", record.signature, "Bills").label == "Bills" and label("me").label == "Bills"
    other = memory.layered(memory.Memory(), own)
    assert [r.label for r in other.records] == ["Bills"]

    def away():
        raise OSError("no store")

    down = memory.BestEffort(away)
    down.remember("k", "v")
    assert down.get("k") is None and label("you", tier=down).status == "needs_input"
    saved = []
    memory.BestEffort(lambda: memory.Patterns({"a": "b"}), saved.append).remember("k", "v")
    assert saved[0].answers == {"a": "b", "k": "v"}


def test_workbooks_give_cells(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Date</t></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2" s="1"><v>45000</v></c></row></sheetData></worksheet>')
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = {(r["sheet"], r["row_ix"], r["col_ix"], r["s"] if r["sheet"] else None, r["n"], r["fmt"]) for r in workbook.workbooks(spark, f"file://{tmp_path}/*.xlsx").collect()}
    assert rows == {("One", 0, 0, "Date", None, None), ("One", 0, 27, "x", None, None), ("One", 1, 0, "45000", 45000.0, "mm-dd-yy"), (None, -1, -1, None, None, None)}
    assert [workbook.column_letters(i) for i in (0, 26, 27)] == ["A", "AA", "AB"]


def test_refresh_runs_only_on_changes(spark, tmp_path):
    seen = []
    refresh = Refresh(lambda df: seen.append(df.count()))
    a = spark.createDataFrame([(1,), (2,)], "x int")
    assert refresh(a) and not refresh(a.orderBy("x", ascending=False)) and refresh(a.union(a))
    assert seen == [2, 4]
    state = str(tmp_path / "hash")
    first, restarted = (Refresh(lambda df: seen.append(-1), state) for _ in range(2))
    assert first(a) and not restarted(a) and restarted(a.union(a)) and seen[2:] == [-1, -1]
    a.write.parquet(str(tmp_path / "in"))
    counts = []
    keep_fresh(spark.readStream.schema("x int").parquet(str(tmp_path / "in")), str(tmp_path / "table"), lambda df: counts.append(df.count()), str(tmp_path / "ckpt")).awaitTermination(60)
    assert counts[-1] == 2


def test_only_touched_slices_are_computed(spark, tmp_path):
    seen = []

    def count_by_vendor(rows):
        seen.append({r["vendor"] for r in rows.select("vendor").distinct().collect()})
        return rows.groupBy("vendor").agg(F.count("*").alias("n")).filter("n < 3")

    table, findings, arrivals = (str(tmp_path / name) for name in ("table", "findings", "in"))
    for part in ([("a", 1), ("b", 1), (None, 1)], [("a", 2)], [("b", 2), ("b", 3)]):
        spark.createDataFrame(part, "vendor string, x int").coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("vendor string, x int").parquet(arrivals)
        keep_slices_fresh(stream, table, "vendor", count_by_vendor, findings, str(tmp_path / "ckpt")).awaitTermination(60)
    assert seen == [{"a", "b", None}, {"a"}, {"b"}]
    assert {tuple(r) for r in latest_slices(spark, findings, "vendor").collect()} == {("a", 2), (None, 1)}  # b has three rows by now


def test_a_batch_reads_the_folders_of_its_own_keys(spark, tmp_path):
    arrivals, table, findings = (str(tmp_path / name) for name in ("in", "table", "found"))
    spark.range(400).selectExpr("concat('v', id % 97) as vendor", "id as x").write.parquet(arrivals)
    stream = spark.readStream.schema("vendor string, x long").parquet(arrivals)
    keep_slices_fresh(stream, table, "vendor", lambda rows: rows.groupBy("vendor").count(), findings, str(tmp_path / "ckpt"), buckets=16).awaitTermination(60)
    part = slices(spark, table, spark.createDataFrame([("v3",), ("none",)], "vendor string"), "vendor", 0, buckets=16)
    assert {r["x"] for r in part.collect()} == set(range(3, 400, 97))
    assert 0 < part.select("*", F.input_file_name().alias("f")).select("f").distinct().count() <= 2
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert latest_slices(spark, findings, "vendor").agg(F.sum("count")).first()[0] == 400


def test_order_of_a_long_column_does_not_depend_on_its_stretches(spark, monkeypatch):
    values = [5, 3, 3, 8, 8, 8, 1, 2, 9, 9, 4, 7]
    grid = [["key", "number"], *(["k", x] for x in values)]
    steps = list(zip(values, values[1:], strict=False))
    first = list(dict.fromkeys(values))
    for stretch in (1 << 16, 3, 1):
        monkeypatch.setattr(cells, "STRETCH", stretch)
        row = cells.profile(cells.from_grids(spark, {"s": grid})).filter("col_ix = 1").first()
        assert row["increasing"] == sum(a <= b for a, b in steps) / len(steps) and row["decreasing"] == sum(a >= b for a, b in steps) / len(steps)
        assert row["samples"] == [str(x) for x in first[:5]]
        assert row["top_values"] == [str(x) for x in sorted(first, key=lambda x: (-values.count(x), first.index(x)))[:5]]
        assert (row["n_numbers"], row["n_distinct"], row["filled"]) == (12, 8, 12)


def test_headings_name_fields_by_words_and_parts():
    named = {
        "state ut tax": {"sgst"}, "union territory gst": {"sgst"}, "statement tax": set(), "state of supply": set(), "tv": {"taxable_value"}, "tvs": set(), "txbl val": {"taxable_value"},
        "invoice no": {"invoice_number"}, "invoice details": {"invoice_number"}, "invoice date": set(), "voucher type": set(), "voucher num": {"voucher_number"}, "igst rate": {"igst", "rate"}, "": set(),
        "central tax": {"cgst"}, "supplier name": {"trade_legal_name"}, "gstr 2a period": {"filing_period"}, "is rcm": {"reverse_charge"},
    }
    assert {heading: recognition.fields_named(heading) for heading in named} == named


def test_foremost_values_are_kept_by_task_before_the_shuffle(spark):
    grid = [["key", "number"], *([f"k{i % 50}", i % 7] for i in range(300))]
    profile = cells.profile(cells.from_grids(spark, {"s": grid}))
    found = {r["col_ix"]: (r["top_values"], r["samples"]) for r in profile.collect()}
    assert found == {0: ([f"k{i}" for i in range(5)],) * 2, 1: (["0", "1", "2", "3", "4"],) * 2}  # 0 to 5 stand once more than 6
    assert profile._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4


@pytest.mark.parametrize("stretch", [6, 7, 50, 1 << 16])
def test_headers_are_found_across_stretches(spark, stretch):
    rng = random.Random(1)
    grids = {}
    for n in range(40):
        rows = [["" for _ in range(3)] for _ in range(60)]
        for i in rng.sample(range(60), rng.randint(0, 12)):
            rows[i] = [rng.choice(["word", 5, "", "7"]) for _ in range(3)]
        grids[f"s{n}"] = [["only", "", ""], *rows]
    want = {}
    for name, rows in grids.items():
        filled = [[c for c in row if c != ""] for row in rows]
        wordy = [sum(c in ("word", "only") for c in row) for row in filled]
        want[name] = next((i for i, row in enumerate(filled) if len(row) >= 2 and wordy[i] >= 0.6 * len(row) and any(filled[i + 1 : i + 6])), -1)
    assert {r["sheet"]: r["header_ix"] for r in cells.header_rows(cells.from_grids(spark, grids), stretch).collect()} == want
    assert len(set(want.values())) > 10
