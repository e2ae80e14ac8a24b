"""Checks of the raw sheets behind a monthly profit-and-loss report: doubtful rows, renamed vendors, missing subtotals.

Every check is a filter or one aggregation; ``CHECKS`` says which of them a
report row calls for.  Nothing is corrected, only pointed out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report rows, the categories they sum, and subtotals with what they need.
ROW_CATEGORIES = {"food cost": "food", "beverage cost": "beverage", "rent": "rent", "utilities": "utilities"}
SUPPLIER_PAYMENT, PAYOUT = "Supplier Payment", "Delivery Platform Payout"
SUBTOTALS = (
    ("total revenue", ("dine-in", "takeaway", "delivery revenue (net of commission)", "events / catering"), False),
    ("total cogs", ("food cost", "beverage cost"), False),
    ("gross profit", ("total revenue", "total cogs"), True),
    ("total operating expenses", ("payroll cost (excl. tronc)", "rent", "utilities", "other opex (cleaning, maintenance, marketing)"), False),
    ("ebitda", ("gross profit", "total operating expenses"), True),
)


def untaxed_beverages(invoices: DataFrame) -> DataFrame:
    """Beverage invoices at a VAT rate of zero."""
    return invoices.filter((F.lower("category") == "beverage") & (F.col("vat_rate") == 0))


def noted_price_rises(invoices: DataFrame) -> DataFrame:
    """Food invoices whose notes speak of a price: a rise of cost may come from there, or from waste."""
    return invoices.filter((F.lower("category") == "food") & F.contains(F.lower("notes"), F.lit("price")))


def payments_without_invoice(bank: DataFrame) -> DataFrame:
    """Supplier payments that no invoice on file explains, with the payee."""
    open_ = bank.filter((F.col("category") == SUPPLIER_PAYMENT) & (F.coalesce("matched_invoice_id", F.lit("")) == ""))
    return open_.withColumn("payee", F.regexp_replace("description", r"(?i)^PAYMENT - ", ""))


def dotted_dates(bank: DataFrame) -> DataFrame:
    """Platform payouts whose date was typed with dots."""
    return bank.filter((F.col("category") == PAYOUT) & F.col("date_as_entered").rlike(r"\d{2}\.\d{2}\.\d{4}"))


def passed_on_tips(payroll: DataFrame) -> DataFrame:
    """Payroll rows with tips that pass through to staff and are no cost."""
    return payroll.filter("tronc > 0")


def renamed_within(invoices: DataFrame, renames: DataFrame, category: str) -> DataFrame:
    """``canonical, aliases`` of renamed vendors, one of whose names stands in ``category``. ``renames``: ``canonical, alias``."""
    own = invoices.filter(F.lower("category") == category.lower()).select(F.col("vendor").alias("alias")).distinct()
    touched = renames.join(own, "alias", "left_semi").select("canonical").distinct()
    named = renames.join(touched, "canonical", "left_semi").groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return named.filter(F.size("aliases") > 1)


def with_canonical_vendor(invoices: DataFrame, renames: DataFrame) -> DataFrame:
    """``invoices`` with the name under which a vendor first stood; a name without a cluster is its own."""
    names = renames.select(F.col("alias").alias("vendor"), F.col("canonical").alias("canonical_vendor"))
    return invoices.join(names, "vendor", "left").withColumn("canonical_vendor", F.coalesce("canonical_vendor", "vendor"))


CHECKS: dict[str, tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...]] = {
    "food cost": (("supplier_invoices", noted_price_rises),),
    "beverage cost": (("supplier_invoices", untaxed_beverages),),
    "other opex (cleaning, maintenance, marketing)": (("bank_statement", payments_without_invoice),),
    "delivery revenue (net of commission)": (("bank_statement", dotted_dates),),
    "payroll cost (excl. tronc)": (("payroll", passed_on_tips),),
}


def checks_for(label: str, tables: Mapping[str, DataFrame], dismissed: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
    """What the checks of a report row find, by check; dismissed checks and those whose table is missing are left out."""
    return {check.__name__: check(tables[table]) for table, check in CHECKS.get(label.strip().lower(), ()) if table in tables and check.__name__ not in dismissed}


def missing_subtotals(report: Sequence[Sequence], header_ix: int) -> list[str]:
    """Subtotal rows of a report grid that are blank although their parts are there. The last row with a label counts."""
    rows = {str(row[0]).strip().lower(): row[1:] for row in report[header_ix + 1 :] if row}
    numbers = lambda label: any(isinstance(c, int | float) and not isinstance(c, bool) and c != 0 for c in rows.get(label, ()))
    blank = lambda label: all(c in ("", 0, None) for c in rows.get(label, ()))
    return [label for label, parts, all_parts in SUBTOTALS if blank(label) and (not any(map(blank, parts)) if all_parts else any(map(numbers, parts)))]


def report_stage(report: Sequence[Sequence], header_ix: int) -> str | None:
    """What a report lacks next: ``layout``, ``totals`` or ``variance``; None if nothing, or if it has no header."""
    if len(report) <= 1:
        return "layout"
    if header_ix < 0:
        return None
    data = report[header_ix + 1 :]
    if not any("total" in str(row[0]).lower() for row in data if row):
        return "totals" if any(c not in ("", None) for row in data for c in row) else None
    header = [str(c).lower() for c in report[header_ix]]
    return None if any(word in h for h in header for word in ("variance", "vs", "budget")) else "variance"
