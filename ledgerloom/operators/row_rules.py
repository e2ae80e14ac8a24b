"""Rules over single rows: tax heads, rates, reverse charge and blocked credit."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers as ids
from ledgerloom.functions.amounts import rate_percent
from ledgerloom.operators.invoices import canonical, digit_bridges, indexable
from ledgerloom.plans.fixed import BLOCKED_CATEGORIES, CONSTANT_SAMPLE, CONSTANT_SHARE, NO, RATE_SHARE, RCM_CATEGORIES, TOLERANCE, YES


def tax_head(igst: Column, cgst: Column, sgst: Column) -> Column:
    """The head that a row charges; amounts within the tolerance count as none."""
    integrated = F.abs(igst) > TOLERANCE
    local = (F.abs(cgst) > TOLERANCE) | (F.abs(sgst) > TOLERANCE)
    return F.when(integrated & local, "mixed").when(integrated, "igst").when(local, "cgst_sgst").otherwise("none")


def expected_head(gstin: Column, place: Column) -> Column:
    """What the supplier's state and the place of supply call for; null if one is unknown."""
    return F.when(ids.state_of_gstin(gstin) == ids.state_of_place(place), "cgst_sgst").when(ids.state_of_gstin(gstin) != ids.state_of_place(place), "igst")


def wrong_head(gstr2a: DataFrame) -> DataFrame:
    """Rows that charge both heads, or the one that their states do not call for."""
    vendor = F.upper(F.trim("gstin"))
    amounts = [F.coalesce(h, F.lit(0)) for h in ("igst", "cgst", "sgst")]
    rows = gstr2a.filter(F.trim("gstin") != "").withColumns({"gstin": vendor, "actual": tax_head(*amounts)})
    rows = rows.withColumn("expected", expected_head(F.col("gstin"), F.col("place_of_supply"))).filter("expected is not null and actual <> 'none' and actual <> expected")
    issue = F.when(F.col("actual") == "mixed", "mixed_tax_heads").otherwise("wrong_head")
    return rows.select("row_index", "gstin", "identifier", issue.alias("issue"), "expected", "actual", "igst", "cgst", "sgst")


def cross_wrong_head(gstr2a: DataFrame, books: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """Invoices on both sides (by number, or by digit bridge) with clean heads that differ, and the side at fault if known. ``bridges``: ``digit_bridges`` of both, if they are known."""
    a, b = (indexable(canonical(side)) for side in (gstr2a, books))
    heads = lambda side, p: side.groupBy("gstin", "identifier").agg(F.count("*").alias(f"{p}_n"), *(F.first(c).alias(f"{p}_{c}") for c in ("row_index", "igst", "cgst", "sgst")))
    ka, kb = heads(a, "a"), heads(b, "b")
    exact = ka.join(kb, ["gstin", "identifier"])
    bridged = ka.join(digit_bridges(a, b) if bridges is None else bridges, ["gstin", "identifier"]).join(kb.withColumnRenamed("identifier", "other_identifier"), ["gstin", "other_identifier"]).drop("other_identifier")
    pairs = exact.unionByName(bridged).filter("a_n = 1 and b_n = 1")
    for p in "ab":
        pairs = pairs.withColumn(f"{p}_head", tax_head(*(F.col(f"{p}_{h}") for h in ("igst", "cgst", "sgst"))))
    pairs = pairs.filter("a_head in ('igst', 'cgst_sgst') and b_head in ('igst', 'cgst_sgst') and a_head <> b_head")
    places = gstr2a.select(F.col("row_index").alias("a_row_index"), "place_of_supply")
    pairs = pairs.join(places, "a_row_index").withColumn("expected", expected_head(F.col("gstin"), F.col("place_of_supply")))
    side = F.when(F.col("a_head") == F.col("expected"), "books").when(F.col("b_head") == F.col("expected"), "gstr2a")
    return pairs.select("gstin", "identifier", "a_row_index", "b_row_index", "a_head", "b_head", "expected", side.alias("incorrect_side"))


def rate_mismatch(invoices: DataFrame) -> DataFrame:
    """Rows whose tax is off from taxable value times rate by more than a rupee and 1 % of it. A tax id is not needed."""
    tv, rate = F.coalesce("taxable_value", F.lit(0)), rate_percent(F.coalesce(F.col("rate").cast("double"), F.lit(0.0)))
    actual = F.coalesce("igst", F.lit(0)) + F.coalesce("cgst", F.lit(0)) + F.coalesce("sgst", F.lit(0))
    rows = invoices.withColumns({"rate_percent": rate, "actual_tax": actual, "expected_tax": F.floor(tv * rate / 100 + 0.5).cast("long")})
    rows = rows.withColumn("difference", F.col("actual_tax") - F.col("expected_tax"))
    rows = rows.filter(F.abs("difference") > F.greatest(F.lit(float(TOLERANCE)), F.col("expected_tax") * RATE_SHARE))
    return rows.select("row_index", "gstin", "identifier", "taxable_value", "rate_percent", "expected_tax", "actual_tax", "difference")


@dataclass(frozen=True)
class Description:
    """Whether a text column describes transactions, and why."""

    usable: bool
    reason: str
    vendors: int
    constant: int
    is_name: bool = False


def description_variability(invoices: DataFrame) -> DataFrame:
    """One row: vendors with several rows and some text, and those of them with one text only."""
    text = F.lower(F.trim("particulars"))
    rows = invoices.filter(F.trim("gstin") != "").select(F.upper(F.trim("gstin")).alias("gstin"), F.when(text != "", text).alias("text"))
    by_vendor = rows.groupBy("gstin").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.min("text").alias("least"), F.max("text").alias("most"))
    judged = by_vendor.filter("n >= 2 and with_text > 0")
    return judged.agg(F.count("*").alias("vendors"), F.coalesce(F.sum((F.col("least") == F.col("most")).cast("long")), F.lit(0)).alias("constant"))


def describe(invoices: DataFrame) -> Description:
    """Judge the text column; one small job. A text that stays the same for most vendors is a name, not a description."""
    if "particulars" not in invoices.columns:
        return Description(False, "no text column", 0, 0)
    vendors, constant = description_variability(invoices).first()
    if vendors < CONSTANT_SAMPLE:
        return Description(True, "too few vendors with several rows to judge", vendors, constant)
    usable = constant / vendors < CONSTANT_SHARE
    return Description(usable, "text varies within vendors" if usable else "text is constant for most vendors", vendors, constant, is_name=not usable)


def _mentions(text: Column, keywords: Iterable[str]) -> Column:
    """Whether any keyword stands in the text: one pass that spares most rows the search by category."""
    return text.rlike("|".join(map(re.escape, keywords)))


def _first_category(text: Column, categories: list[tuple[str, tuple[str, ...], Column]]) -> Column:
    """Id of the first category with a keyword anywhere in the text, also inside of words."""
    found = F.lit(None).cast("string")
    for name, keywords, applies in reversed(categories):
        if keywords:
            found = F.when(_mentions(text, keywords) & applies, F.lit(name)).otherwise(found)
    return found


def reverse_charge_flag(cell: Column) -> Column:
    text = F.lower(F.trim(cell))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


def reverse_charge(invoices: DataFrame, description: bool = True) -> DataFrame:
    """Rows under reverse charge: by their own flag, or else by keywords. Rows without a tax id count too."""
    unregistered = F.trim(F.coalesce("gstin", F.lit(""))) == ""
    categories = [(name, words, unregistered if only else F.lit(True)) for name, words, only, _ in RCM_CATEGORIES]
    by_text = _first_category(F.lower("particulars"), categories) if description else F.lit(None).cast("string")
    flag = reverse_charge_flag(F.col("reverse_charge"))
    hinted = _mentions(F.lower("particulars"), (w for _, words, _, _ in RCM_CATEGORIES for w in words)) if description else F.lit(False)
    rows = invoices.withColumn("flag", flag).filter(F.col("flag") | (F.col("flag").isNull() & hinted))
    rows = rows.withColumn("category", F.when(F.col("flag").isNull(), by_text))
    confirm = [name for name, _, _, by_hand in RCM_CATEGORIES if by_hand]
    rows = rows.filter("flag or category is not null")
    found_by = F.when(F.col("flag"), "reverse_charge_flag").otherwise("keyword_match")
    vendor = F.when(~unregistered, F.upper(F.trim("gstin")))
    return rows.select(
        "row_index", vendor.alias("gstin"), "identifier", found_by.alias("found_by"), "category", F.coalesce(F.col("category").isin(*confirm), F.lit(False)).alias("confirm"), "igst", "cgst", "sgst"
    )


def blocked_credit(invoices: DataFrame, description: bool = True) -> DataFrame:
    """Rows whose text names a category of blocked credit, with the keyword that does."""
    if not description:
        return invoices.filter("false").select("row_index", "gstin", "identifier", F.lit("").alias("category"), F.lit("").alias("section"), F.lit("").alias("keyword"), "igst", "cgst", "sgst")
    text = F.lower("particulars")
    category = _first_category(text, [(name, words, F.lit(True)) for name, _, words in BLOCKED_CATEGORIES])
    keyword = F.lit(None).cast("string")
    for name, _, words in BLOCKED_CATEGORIES:
        if words:
            hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
            keyword = F.when(F.col("category") == name, F.get(hits, F.lit(0))).otherwise(keyword)
    sections = F.create_map(*(F.lit(x) for name, section, _ in BLOCKED_CATEGORIES for x in (name, section)))
    rows = invoices.filter((F.trim("gstin") != "") & _mentions(text, (w for _, _, words in BLOCKED_CATEGORIES for w in words))).withColumn("category", category).filter("category is not null")
    return rows.select("row_index", F.upper(F.trim("gstin")).alias("gstin"), "identifier", "category", sections[F.col("category")].alias("section"), keyword.alias("keyword"), "igst", "cgst", "sgst")
