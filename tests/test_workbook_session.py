"""Raw sheets, hygiene checks, labels, screening, explanations, and the way from a workbook to a proposal."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import explain, hygiene, ledgers, renames, report, screening
from ledgerloom.plans import memory, recognition, session, vocabulary
from ledgerloom.sources import cells, sheets

A, B, C = "27AAAPL0001Q1Z5", "29AAAPL0002Q1Z5", "27AAAPL0003Q1Z5"
STATEMENT = [
    ["GSTIN of Supplier", "Trade/Legal Name", "Invoice Number", "Invoice Date", "Taxable Value", "Rate", "Integrated Tax", "Central Tax", "State/UT Tax", "Place of Supply"],
    [A, "Alpha", "INV/1", "2024-04-01", 1000.0, 18, 0, 90.0, 90.0, "27-Maharashtra"],
    [B, "Beta", "INV/2", "2024-04-02", 2000.0, 18, 360.0, 0, 0, "27-Maharashtra"],
    [C, "Gamma", "INV/3", "2024-04-03", 3000.0, 18, 540.0, 0, 0, "27-Maharashtra"],
]
REGISTER = [
    ["Purchase register"],
    ["Date", "Particulars", "Voucher Type", "Voucher No.", "GSTIN/UIN", "TV", "IGST", "CGST", "SGST"],
    ["2024-04-01", "Goods", "Purchase", "INV/1", A, 1000.0, 0, 90.0, 90.0],
    ["2024-04-02", "Outdoor catering", "Purchase", "INV/2", B, 2000.0, 300.0, 0, 0],
    ["2024-04-04", "Lots", "Purchase", "X9", "29AAAPL0004Q1Z5", 500.0, 90.0, 0, 0],
]
TITLE = [["Report"], [], ["x"]]
RAW = {
    "inv": [*TITLE, ["Invoice ID"], ["I1", "s", " Fresh Fields Produce Ltd ", 45000, "Food", 10, 0, 0, 10, "", "price up"], ["", "s", "no id"], ["I2", "s", "Fresh Fields Wholesale Ltd", "2024-01-02", "Beverage", "1,000.50", 0, 0, 10, "", ""]],
    "bank": [*TITLE, ["Date"], [45000, "15.03.2023", "s", "UberEats payout", 5, "Delivery Platform Payout", "", ""], [45001, "16/03/2023", "s", "payment - Acme", -7, "Supplier Payment", "", ""]],
    "pay": [*TITLE, ["Month"], ["May 2026", "s", 1, 2, 0, 1, 1, 5], ["Jun 2026", "s", 1, 2, 3, 1, 1, 8]],
}


@pytest.fixture(scope="module")
def raw(spark):
    all_cells = cells.from_grids(spark, RAW)
    pick = lambda sheet, kind: sheets.raw_sheet(all_cells.filter(f"sheet = '{sheet}'"), kind, 4)
    return {"supplier_invoices": pick("inv", "supplier_invoices"), "bank_statement": pick("bank", "bank_statement"), "payroll": pick("pay", "payroll")}


def test_raw_sheets_by_position(raw):
    rows = raw["supplier_invoices"].orderBy("row_index").collect()
    assert [(r["invoice_id"], r["vendor"], str(r["invoice_date"]), r["net"]) for r in rows] == [("I1", "Fresh Fields Produce Ltd", "2023-03-15", 1000), ("I2", "Fresh Fields Wholesale Ltd", "2024-01-02", 100050)]
    assert [r["tronc"] for r in raw["payroll"].orderBy("row_index").collect()] == [0, 300]


def test_raw_sheets_start_at_the_fourth_row(spark):
    found = sheets.raw_sheet(cells.from_grids(spark, {"pay": [*TITLE, ["May 2026", "s", 1]]}), "payroll").collect()
    assert [(r["row_index"], r["month"], r["basic"], r["tronc"]) for r in found] == [(3, "May 2026", 100, 0)]


def test_sheets_of_one_name_in_two_workbooks_stay_apart(spark):
    grids = [[["Invoice no", "Supplier", "Amount", "Date"], ["I1", "x", 1, ""]], [["Title"], ["Invoice no", "Supplier", "Amount", "Date"], ["I2", "y", 2, ""]]]
    parts = [cells.from_grids(spark, {"Sheet1": grid}).select(F.lit(f"{i}.xlsx").alias("path"), "*") for i, grid in enumerate(grids)]
    both = parts[0].unionByName(parts[1])
    assert {(r["path"], r["invoice_no"], r["amount"]) for r in sheets.ledger_rows(both).collect()} == {("0.xlsx", "I1", 100), ("1.xlsx", "I2", 200)}
    assert {r["path"]: r["header_ix"] for r in cells.header_rows(both).collect()} == {"0.xlsx": 0, "1.xlsx": 1}
    assert {(r["path"], r["header"]) for r in cells.profile(both).filter("col_ix = 0").collect()} == {("0.xlsx", "Invoice no"), ("1.xlsx", "Invoice no")}
    with pytest.raises(ValueError, match="several workbooks"):
        recognition.read_sheets(both)


def test_hygiene_checks(raw):
    found = {label: {name: rows.count() for name, rows in hygiene.checks_for(label, raw).items()} for label in hygiene.CHECKS}
    assert found == {
        "food cost": {"noted_price_rises": 1},
        "beverage cost": {"untaxed_beverages": 1},
        "other opex (cleaning, maintenance, marketing)": {"payments_without_invoice": 1},
        "delivery revenue (net of commission)": {"dotted_dates": 1},
        "payroll cost (excl. tronc)": {"passed_on_tips": 1},
    }
    assert hygiene.payments_without_invoice(raw["bank_statement"]).first()["payee"] == "Acme"
    assert hygiene.checks_for("food cost", raw, frozenset({"noted_price_rises"})) == {} and hygiene.checks_for("food cost", {}) == {}


def test_renames_within_a_category(raw):
    invoices = raw["supplier_invoices"]
    found = renames.vendor_renames(invoices)
    assert hygiene.renamed_within(invoices, found, "FOOD").first()["aliases"] == ["Fresh Fields Produce Ltd", "Fresh Fields Wholesale Ltd"]
    assert hygiene.renamed_within(invoices, found, "rent").isEmpty()
    assert {r["canonical_vendor"] for r in hygiene.with_canonical_vendor(invoices, found).collect()} == {"Fresh Fields Produce Ltd"}


def test_subtotals_and_stages():
    grid = [["P&L"], ["Line item", "May 2026", "Jun 2026"], ["Gross Profit"], ["Food Cost", 5, 6], ["Total COGS", "", ""], ["Gross Profit", "", ""], ["Total Revenue", 9, 9]]
    assert hygiene.missing_subtotals(grid, 1) == ["total cogs"]
    grid[4] = ["Total COGS", 5, 6]
    assert hygiene.missing_subtotals(grid, 1) == ["gross profit"]
    assert [hygiene.report_stage(g, h) for g, h in (([], -1), (grid, 1), (grid[:4], 1), (grid, -1), ([["a", "b", "Variance"], ["Total", 1, 2]], 0))] == ["layout", "variance", "totals", None, None]


def test_headers_ledgers_and_totals(spark):
    grids = {"l": [["My ledger"], ["Invoice No", "Supplier", "Amount", "Date"], ["A1", " Acme ", "1,200.5", 45000], [0, "zero"], ["A2", "Bee", "x", " 1/2/2024 "]], "n": [["K1", "Cee", 3, "d"], ["K2"]]}
    rows = {(r["sheet"], r["invoice_no"]): (r["supplier"], r["amount"], r["date"]) for r in sheets.ledger_rows(cells.from_grids(spark, grids)).collect()}
    assert rows == {("l", "A1"): ("Acme", 120050, "15/03/2023"), ("l", "A2"): ("Bee", None, "1/2/2024"), ("n", "K2"): (None, None, None)}
    report_cells = cells.from_grids(spark, {"p": [["P&L for 2026"], ["Line", "May 2026", "Jun 2026"], ["Rent", 1, 2], ["Food", 3, 4]], "q": [["a", "b"]]})
    assert {r["sheet"]: r["header_ix"] for r in sheets.report_header(report_cells).collect()} == {"p": 1, "q": -1}
    assert {(r["sheet"], r["row_ix"]) for r in sheets.data_rows(report_cells).collect()} == {("p", 1), ("p", 2), ("p", 3), ("q", 0)}
    assert {r["col_ix"]: r["total"] for r in sheets.totals_row(report_cells.filter("sheet = 'p'"), 1).collect()} == {1: 4.0, 2: 6.0}


def test_label_plausibility():
    check = vocabulary.plausible_label
    assert check("Supplier bills", ["Bill No", "Date"]).shared == ("bills",)
    assert not check("Payroll", ["Invoice Number", "Supplier"]).plausible
    assert check("the data", ["Invoice"]).reason == "not_enough_signal" and check("x", []).plausible
    assert [vocabulary.stem(w) for w in ("entries", "boxes", "bills", "gas")] == ["entry", "box", "bill", "gas"]


def test_screening_by_name_and_by_call(spark):
    vendors = spark.createDataFrame([("g1", "City Motors"), ("g2", "Grand Hotel"), ("g3", "Steel"), ("g4", "Life Insurance Co"), ("g5", None)], "gstin string, vendor_name string")
    assert {r["gstin"]: r["sub_clause"] for r in screening.by_name(vendors).collect()} == {"g1": "17(5)(a)/(ab)", "g2": "17(5)(b)(i)", "g3": None, "g4": "17(5)(b)", "g5": None}

    def answers(batch):
        assert all(set(v) == {"gstin", "vendor_name"} for v in batch)
        return [{"gstin": v["gstin"], "flagged": v["gstin"] == "g1", "reasoning": "r", "category": 5} for v in batch if v["gstin"] != "g3"] + [{"gstin": "unasked", "flagged": True, "reasoning": "r"}, {"gstin": "g3"}, None]

    results, missing = screening.screened(vendors, answers, batch=2)
    assert {(r["gstin"], r["flagged"], r["category"]) for r in results.collect()} == {(g, g == "g1", None) for g in ("g1", "g2", "g4", "g5")}
    assert [r["gstin"] for r in missing.collect()] == ["g3"]
    assert screening.wanted(vendors.filter("false")) and not screening.wanted(vendors)


def test_workbook_to_proposal(spark, tmp_path):
    p = session.reconcile_workbook(cells.from_grids(spark, {"a": STATEMENT, "b": REGISTER}), "me")
    status = {r["gstin"]: r["status"] for r in p.vendors.collect()}
    assert status == {A: "matched", B: "discrepancy", C: "missing_in_books", "29AAAPL0004Q1Z5": "missing_in_gstr2a"}
    assert [r["identifier"] for r in p.wrong_head.collect()] == ["INV/3"]
    found = explain.explained_tables(p)
    assert set(found) == set(report.tables(p))
    for name, rows in found.items():
        if name != "summary":
            assert all(r["rule"] and r["finding"] and r["ground"] for r in rows.collect()), name
    wrong = found["wrong_head"].first()
    assert wrong["finding"] == f"invoice INV/3 of {C} is charged IGST, should be CGST+SGST"
    places = report.accept(p, str(tmp_path / "report"))
    again = report.ranked_from_written(spark, places)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in report.top_issues(p).collect()}
    lines = {r["label"] for r in found["summary"].collect()}
    assert set(explain.LINEAGE) <= lines


def test_ambiguous_columns_are_asked_for_once(spark):
    doubled = [[*row, *extra] for row, extra in zip(REGISTER[1:], (["Input IGST"], [0], [300.0], [90.0]), strict=True)]
    book = cells.from_grids(spark, {"a": STATEMENT, "b": doubled})
    with pytest.raises(memory.ColumnsUnresolved) as asked:
        session.reconcile_workbook(book, "me")
    assert asked.value.fields == [("igst", "ambiguous")]
    found, own, shared = session.recognize(book), memory.Memory(), memory.Patterns()
    session.answer(found, "b", "igst", 6, "me", own, shared)
    assert session.reconcile_workbook(book, "me", own).vendors.count() == 4
    assert session.reconcile_workbook(book, "you", None, shared).vendors.count() == 4
    with pytest.raises(ValueError):
        session.reconcile_workbook(cells.from_grids(spark, {"a": STATEMENT}), "me")


def test_patterns_last_answer_counts(spark, tmp_path):
    store = memory.Patterns()
    store.remember("k", "a")
    store.remember("k", "b")
    store.write(spark, str(tmp_path / "p"))
    read = memory.Patterns.read(spark, str(tmp_path / "p"))
    assert read.get("k") == "b" and read.forget("k") and not read.forget("k")


def test_standing_checks_run_on_all_sources(spark):
    book = cells.from_grids(spark, {"a": STATEMENT})
    found = session.recognize(book)
    rows = sheets.invoices(book, "a", found.headers["a"], found.maps["a"].found | {"rate": 5})
    assert {(r["source"], r["identifier"]) for r in session.validated({"x": rows, "y": rows.withColumn("igst", rows["igst"] + 50000)})["rate_mismatch"].collect()} == {("y", f"INV/{i}") for i in (1, 2, 3)}


def test_remembered_labels_give_sheets_their_role(spark):
    book = cells.from_grids(spark, {"a": STATEMENT, "b": REGISTER})
    assert session.recognize(book).workflow == "gstr2a_vs_books" and session.recognize(book).labels["a"].status == "classified"
    book = cells.from_grids(spark, {"a": STATEMENT, "x": [["Ref", "GSTIN/UIN", "IGST"], *([row[3], row[4], row[6]] for row in REGISTER[2:])]})
    found, labels = session.recognize(book), memory.Memory()
    assert found.chosen is None and found.workflow is None and found.labels["x"].status == "needs_input"
    memory.remember_label(labels, "me", found.columns["x"], "x", "purchase_register")
    again = session.recognize(book, "me", labels)
    assert again.labels["x"].status == "remembered" and again.chosen == {"gstr2a": "a", "purchase_register": "x"}
    assert session.recognize(book, "you", labels).chosen is None
