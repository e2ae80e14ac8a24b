"""Typed tables from cells: raw sheets of a known layout, ledgers, and invoices whose columns were recognised.

A sheet row is put together by one aggregation over the cells of the columns
that are wanted, so only those are shuffled.  ``row_index`` is the sheet's row,
from 0; ``row_index + 1`` is the number that a spreadsheet shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import date_or_null, number_or_null, paise
from ledgerloom.sources.cells import sheet_keys

# The columns of the raw sheets by position, and the column without which a row does not count.
LAYOUTS = {
    "supplier_invoices": ("invoice_id", "site", "vendor", "invoice_date", "category", "net", "vat_rate", "vat_amount", "gross", "status", "notes"),
    "bank_statement": ("date", "date_as_entered", "site", "description", "amount", "category", "matched_invoice_id", "notes"),
    "pos_sales": ("month", "site", "dine_in", "takeaway", "deliveroo", "ubereats", "justeat", "events", "total"),
    "payroll": ("month", "site", "basic", "overtime", "tronc", "ni", "pension", "total"),
}
ROW_KEYS = {"supplier_invoices": "invoice_id", "bank_statement": "description", "pos_sales": "month", "payroll": "month"}
_DATES, _NUMBERS = {"invoice_date", "date"}, {"vat_rate"}
_AMOUNTS = {"net", "vat_amount", "gross", "amount", "dine_in", "takeaway", "deliveroo", "ubereats", "justeat", "events", "total", "basic", "overtime", "tronc", "ni", "pension"}
_LEDGER = {"invoice_no": 0, "supplier": 1, "amount": 2, "date": 3}
_REPORT_WORDS = ("category", "amount", "month", "revenue", "cost", "line item")


def sheet_rows(cells: DataFrame, places: dict[str, int]) -> DataFrame:
    """One row per sheet row that has a cell in one of ``places`` (name to column): ``sheet, row_index``, and each name's text."""
    wanted = cells.filter(F.col("col_ix").isin(sorted(set(places.values()))) & (F.col("s") != ""))
    return wanted.groupBy(*sheet_keys(cells), F.col("row_ix").alias("row_index")).agg(*(F.max(F.when(F.col("col_ix") == i, F.col("s"))).alias(name) for name, i in places.items()))


def _given(cell: str) -> Column:
    """Whether a key cell counts as filled: neither blank nor the number zero."""
    return F.col(cell).isNotNull() & ~F.coalesce(F.col(cell).try_cast("double") == 0, F.lit(False))


def raw_sheet(cells: DataFrame, kind: str, first_row: int = 3) -> DataFrame:
    """A raw sheet of one of the ``LAYOUTS``, from ``first_row`` on (counted from 0; a heading below that place counts as a row): dates as dates, amounts in paise (missing ones zero), the rest trimmed text."""
    names = LAYOUTS[kind]
    rows = sheet_rows(cells.filter(F.col("row_ix") >= first_row), {name: i for i, name in enumerate(names)}).filter(_given(ROW_KEYS[kind]))

    def typed(name: str) -> Column:
        if name in _DATES:
            return date_or_null(F.col(name))
        if name in _AMOUNTS:
            return F.coalesce(paise(F.col(name)), F.lit(0))
        return number_or_null(F.col(name)) if name in _NUMBERS else F.coalesce(F.trim(name), F.lit(""))

    return rows.select(*(k for k in ("path", "sheet", "row_index") if k in rows.columns), *(typed(name).alias(name) for name in names))


def ledger_header(cells: DataFrame) -> DataFrame:
    """``sheet, header_ix`` (and ``path``): the first row with "invoice" in the first column, else 0."""
    hit = (F.col("col_ix") == 0) & F.contains(F.lower("s"), F.lit("invoice"))
    return cells.groupBy(*sheet_keys(cells)).agg(F.coalesce(F.min(F.when(hit, F.col("row_ix"))), F.lit(0)).alias("header_ix"))


def report_header(cells: DataFrame) -> DataFrame:
    """``sheet, header_ix`` (and ``path``): the first row with three filled cells, one of them a word of report headings or with four digits; else -1."""
    word = F.lower("s").rlike(r"\d{4}|" + "|".join(_REPORT_WORDS))
    rows = cells.filter(F.trim("s") != "").groupBy(*sheet_keys(cells), "row_ix").agg(F.count("*").alias("filled"), F.max(word).alias("word"))
    return rows.groupBy(*sheet_keys(cells)).agg(F.coalesce(F.min(F.when((F.col("filled") >= 3) & F.col("word"), F.col("row_ix"))), F.lit(-1)).alias("header_ix"))


def data_rows(cells: DataFrame) -> DataFrame:
    """``sheet, row_ix`` (and ``path``) of rows with a filled cell beyond the first column; titles and notes of a written report fill the first alone."""
    return cells.filter((F.col("col_ix") > 0) & (F.trim("s") != "")).select(*sheet_keys(cells), "row_ix").distinct()


def ledger_rows(cells: DataFrame) -> DataFrame:
    """Ledger or statement rows below the header, as ``operators.ledgers.compare_ledger`` takes them; a serial day number becomes ``dd/MM/yyyy``."""
    rows = sheet_rows(cells, _LEDGER).filter(_given("invoice_no")).join(ledger_header(cells), sheet_keys(cells)).filter("row_index > header_ix")
    serial = F.trim("date").rlike(r"^\d{1,6}(\.\d+)?$")
    date = F.when(serial, F.date_format(date_or_null(F.col("date")), "dd/MM/yyyy")).otherwise(F.trim("date"))
    return rows.select(*sheet_keys(cells), "row_index", F.trim("invoice_no").alias("invoice_no"), F.trim("supplier").alias("supplier"), paise(F.col("amount")).alias("amount"), date.alias("date"))


def invoices(cells: DataFrame, sheet: str, header_ix: int, places: dict[str, int]) -> DataFrame:
    """The invoice table that the operators take, from the columns in ``places`` (field to column, ``date`` included).

    The invoice number goes before the voucher number.  A field without a column
    is null.  Rows need any filled cell among those columns; a blank tax id is kept,
    as reverse charge and rates look at such rows too.
    """
    used = {name: i for name, i in places.items() if i is not None}
    rows = sheet_rows(cells.filter((F.col("sheet") == sheet) & (F.col("row_ix") > header_ix)), used)

    def text(*names: str) -> Column:
        found = next((n for n in names if n in used), None)
        return F.lit(None).cast("string") if found is None else F.trim(found)

    blank = lambda name: F.coalesce(text(name), F.lit(""))
    return rows.select(
        "row_index",
        blank("gstin").alias("gstin"),
        F.coalesce(text("invoice_number", "voucher_number"), F.lit("")).alias("identifier"),
        *(text(name).alias(name) for name in ("trade_legal_name", "particulars", "place_of_supply", "reverse_charge")),
        number_or_null(text("rate")).alias("rate"),
        *(paise(text(name)).alias(name) for name in ("taxable_value", "igst", "cgst", "sgst")),
        date_or_null(text("date")).alias("invoice_date"),
    )


def totals_row(cells: DataFrame, header_ix: int) -> DataFrame:
    """``sheet, col_ix, total`` of every column with a number below the header: what a totals row would hold."""
    return cells.filter((F.col("row_ix") > header_ix) & F.col("n").isNotNull()).groupBy(*sheet_keys(cells), "col_ix").agg(F.sum("n").alias("total"))
