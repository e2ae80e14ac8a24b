"""Ledger against statement, and monthly profit-and-loss roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.identifiers import similarity_percent
from ledgerloom.operators.hygiene import PAYOUT
from ledgerloom.operators.matching import one_letter_apart, similar_names
from ledgerloom.plans.staging import staged

# In the order in which findings are shown.
STATUSES = ("MATCHED", "FUZZY_VENDOR", "AMOUNT_DIFF", "VAT_ISSUE", "DATE_DIFF", "MISSING_SUPPLIER", "MISSING_LEDGER", "DUPLICATE")
SIMILAR = 80
VAT_SHARE, VAT_BAND = 0.20, 0.01
COMMISSION_STEP = 0.01
# Delivery platforms by their column of the sales report, and how bank lines of their payouts start.
PLATFORMS = {"deliveroo": "Deliveroo", "ubereats": "UberEats", "justeat": "JustEat"}


def _similar(own: DataFrame, others: DataFrame) -> DataFrame:
    """Names of ``own`` that are like one of ``others``, but not the same. Only those for which no name one letter aside is found are compared further."""
    near = staged(one_letter_apart(own, others, SIMILAR), "names-near")
    rest = staged(own.join(near, own.columns[0], "left_anti"), "names-left")
    far = similar_names(rest, others, SIMILAR).filter("similarity < 100").select(F.col("name").alias(own.columns[0])).distinct()
    return near.unionByName(far)


def compare_ledger(ledger: DataFrame, statement: DataFrame) -> DataFrame:
    """A status for every ledger row and every statement row that nothing matched.

    Inputs: ``row_index, invoice_no, supplier, amount`` (paise) and ``date``.  The
    tests come in this order: entered before, number on the statement, supplier
    names alike, amounts, dates.  A ledger row meets the first statement row with
    its number.

    First rows are found by minima, combined before the shuffle, so a key that very
    many rows have is no group.  The rows with what they meet are written once, as
    names, statuses and statement rows are read off them.
    """
    number = F.coalesce(F.concat(F.lit("="), "invoice_no"), F.lit("")).alias("number")  # never null, so that missing numbers meet in joins too
    rows = ledger.select("*", number, F.struct(F.lower("supplier").alias("supplier"), "amount", "date").alias("traits"))
    rows = rows.join(rows.groupBy("traits").agg(F.min("row_index").alias("first_alike")), "traits").drop("traits")
    rows = rows.join(rows.groupBy("number").agg(F.min("row_index").alias("first_number")), "number")
    numbered = statement.filter("invoice_no is not null").select(number, F.col("row_index").alias("s_row"), F.col("supplier").alias("s_supplier"), F.col("amount").alias("s_amount"), F.col("date").alias("s_date"))
    first = numbered.join(numbered.groupBy("number").agg(F.min("s_row").alias("s_first")), "number").filter("s_row = s_first").drop("s_first")
    joined = rows.join(first, "number", "left")
    entered = (F.col("first_number") < F.col("row_index")) | (F.col("first_alike") < F.col("row_index"))
    off = F.abs(F.col("amount") - F.col("s_amount"))
    share = F.try_divide(off.cast("double"), F.col("amount").cast("double"))
    status = (
        F.when(entered, "DUPLICATE")
        .when(F.col("s_row").isNull(), None)
        .when(similarity_percent(F.col("supplier"), F.col("s_supplier")) < SIMILAR, "FUZZY_VENDOR")
        .when(off > 0, F.when(F.abs(share - VAT_SHARE) < VAT_BAND, "VAT_ISSUE").otherwise("AMOUNT_DIFF"))
        .when(~F.col("date").eqNullSafe(F.col("s_date")), "DATE_DIFF")
        .otherwise("MATCHED")
    )
    judged = joined.withColumn("status", status)
    judged = staged(judged.select("row_index", "invoice_no", "status", F.when(~entered, F.col("s_row")).alias("s_row"), F.when(F.col("status").isNull(), F.col("supplier")).alias("supplier")), "judged")

    alone = judged.filter("status is null")
    alike = _similar(alone.select("supplier").filter("supplier is not null").distinct(), statement.select("supplier").distinct()).withColumn("similar", F.lit(True))
    alone = alone.join(alike, "supplier", "left").withColumn("status", F.when(F.col("similar"), "FUZZY_VENDOR").otherwise("MISSING_SUPPLIER"))
    missing = statement.join(judged.filter("s_row is not null").select(F.col("s_row").alias("row_index")), "row_index", "left_anti").withColumn("status", F.lit("MISSING_LEDGER"))
    finding = lambda side, rows: rows.select(F.lit(side).alias("side"), "row_index", "invoice_no", "status")
    return finding("ledger", judged.filter("status is not null")).unionByName(finding("ledger", alone)).unionByName(finding("statement", missing))


def status_counts(findings: DataFrame) -> DataFrame:
    """Rows per status of ``compare_ledger``, all eight statuses, in display order."""
    order = findings.sparkSession.createDataFrame(list(enumerate(STATUSES)), "place int, status string")
    counts = findings.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(order).join(counts, "status", "left").orderBy("place").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def conditional_sums(rows: DataFrame, month: Column, lines: dict[str, Column]) -> DataFrame:
    """One row per month, one column per line: the sum of each line's amount expression."""
    return rows.groupBy(month.alias("month")).agg(*(F.coalesce(F.sum(amount), F.lit(0)).alias(name) for name, amount in lines.items()))


def profit_and_loss(months: DataFrame, revenue: list[str], cost: list[str], expenses: list[str]) -> DataFrame:
    """Subtotals beside the named lines, and the change of the result against the month before."""

    def total(names: list[str]) -> Column:
        return sum((F.coalesce(n, F.lit(0)) for n in names), start=F.lit(0).cast("long"))

    out = months.withColumns({"total_revenue": total(revenue), "total_cost": total(cost), "total_expenses": total(expenses)})
    out = out.withColumn("gross_profit", F.col("total_revenue") - F.col("total_cost"))
    out = out.withColumn("ebitda", F.col("gross_profit") - F.col("total_expenses"))
    return out.withColumn("variance", F.col("ebitda") - F.lag("ebitda").over(Window.orderBy("month")))


def commission_drift(gross: DataFrame, net: DataFrame) -> DataFrame:
    """Months in which a platform's commission moved by more than a point. ``gross``, ``net``: ``platform, month, amount``."""
    keys = ["platform", "month"]
    g = gross.groupBy(*keys).agg(F.sum("amount").alias("gross"))
    n = net.groupBy(*keys).agg(F.sum("amount").alias("net"))
    rate = F.when(F.col("gross") > 0, 1 - F.coalesce("net", F.lit(0)) / F.col("gross"))
    rates = g.join(n, keys, "left").withColumn("rate", rate)
    order = Window.partitionBy("platform").orderBy("month")
    moved = rates.withColumn("previous", F.lag("rate").over(order))
    return moved.filter(F.abs(F.col("rate") - F.col("previous")) > COMMISSION_STEP).select(*keys, "previous", "rate")


def platform_sales(sales: DataFrame) -> DataFrame:
    """``platform, month, amount`` of a sales report whose months stand as ``Jun 2026``: gross sales, a row for each report row and platform."""
    month = F.date_format(F.try_to_timestamp("month", F.lit("MMM yyyy")), "yyyy-MM")
    return sales.select(month.alias("month"), *PLATFORMS).filter("month is not null").unpivot("month", list(PLATFORMS), "platform", "amount")


def platform_payouts(bank: DataFrame) -> DataFrame:
    """``platform, month, amount`` of the payouts in a bank statement (``date, description, category, amount``); the start of the description tells the platform."""
    platform = F.coalesce(*(F.when(F.startswith("description", F.lit(name)), column) for column, name in PLATFORMS.items()))
    rows = bank.filter((F.col("category") == PAYOUT) & F.col("date").isNotNull())
    return rows.select(platform.alias("platform"), F.date_format("date", "yyyy-MM").alias("month"), "amount").filter("platform is not null")


def net_of_commission(sales: DataFrame, rates: DataFrame) -> DataFrame:
    """``month, amount``: sales of all platforms less their commission. ``sales`` as ``platform_sales`` gives them; ``rates``: ``platform, month, rate``; sales without a rate are left out."""
    by_platform = sales.groupBy("platform", "month").agg(F.sum("amount").alias("gross"))
    return by_platform.join(rates, ["platform", "month"]).groupBy("month").agg(F.sum(F.col("gross") * (1 - F.col("rate"))).alias("amount"))


def spent_on(category: str) -> Column:
    """What a bank line of ``category`` costs: its amount with the sign turned. For ``conditional_sums``."""
    return F.when(F.col("category") == category, -F.col("amount"))
