"""Amounts, rates and dates from cell text, as column expressions.

A cell that does not hold what is asked for gives null (or zero where the name
says so); nothing raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def number_or_null(cell: Column) -> Column:
    """The number that a cell's text begins with, once ``, $ £ € ¥ % ( )`` are gone. ``(1,234)`` is 1234."""
    plain = F.regexp_replace(cell.cast("string"), r"[,$£€¥%()]", "")
    head = F.regexp_extract(plain, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(head != "", head.try_cast("double"))


def number_or_zero(cell: Column) -> Column:
    return F.coalesce(number_or_null(cell), F.lit(0.0))


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity, as ledgers on spreadsheets do."""
    scale = 10.0**digits
    return F.floor((value + EPSILON) * scale + 0.5) / scale


def paise(cell: Column) -> Column:
    """Whole paise of a cell with rupees; null if there is no number."""
    return F.floor(number_or_null(cell) * 100 + 0.5).cast("long")


def rate_percent(rate: Column) -> Column:
    """Percent; a value between 0 and 1 is a fraction."""
    return F.when((rate > 0) & (rate < 1), rate * 100).otherwise(rate)


def date_or_null(cell: Column) -> Column:
    """A date from ``YYYY-M-D``, ``D-M-YYYY`` or ``D/M/YYYY`` text, or from a serial day number."""
    text = F.trim(cell.cast("string"))
    return F.coalesce(
        *(F.when(text.rlike(shape), F.try_to_date(text, form)) for shape, form in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))),
        F.when(text.rlike(r"^\d{1,6}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(text.try_cast("double")).cast("int"))),
    )


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def same_month(a: Column, b: Column) -> Column:
    return F.trunc(a, "MM") == F.trunc(b, "MM")


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")


def indian_grouping(paise_value: Column) -> Column:
    """Whole rupees with Indian digit groups, e.g. ``2,31,80,361``."""
    digits = F.abs(F.round(paise_value / 100)).cast("long").cast("string")
    head, tail = F.regexp_replace(digits, r"\d{3}$", ""), F.regexp_extract(digits, r"(\d{1,3})$", 1)
    grouped = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), tail))
    return F.concat(F.when(paise_value < 0, F.lit("-")).otherwise(F.lit("")), grouped)


def day_text(date: Column) -> Column:
    """``2024-04-01``, or the empty string."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))


def breakdown_text(igst: Column, cgst: Column, sgst: Column) -> Column:
    """``CGST 90.00 + SGST 90.00`` of amounts in paise, where two heads or more are not zero."""
    part = lambda h: F.concat(h["head"], F.lit(" "), (h["amount"] / 100).cast("decimal(20,2)").cast("string"))
    return F.array_join(F.transform(tax_breakdown(igst, cgst, sgst), part), " + ")


def tax_breakdown(igst: Column, cgst: Column, sgst: Column) -> Column:
    """The heads that are not zero, or null if there are fewer than two."""
    heads = F.array(*(F.struct(F.lit(name).alias("head"), amount.alias("amount")) for name, amount in (("IGST", igst), ("CGST", cgst), ("SGST", sgst))))
    filled = F.filter(heads, lambda h: h["amount"] != 0)
    return F.when(F.size(filled) >= 2, filled)
