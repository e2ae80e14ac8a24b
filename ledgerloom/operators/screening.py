"""Vendors whose business is often a case of blocked credit, judged by name alone: flagged for review, never netted."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.staging import staged

# Name patterns, category and sub-clause. The first pattern that is found counts.
NAME_RULES = (
    (r"(?i)\b(motor|vehicle|car|automobile)s?\b", "Motor Vehicles", "17(5)(a)/(ab)"),
    (r"(?i)\binsuranc", "Insurance (motor/employee-health portion)", "17(5)(b)"),
    (r"(?i)\b(hotel|resort)s?\b", "Food/Beverage/Catering (banquet portion)", "17(5)(b)(i)"),
)
RESULT = "gstin string, vendor_name string, flagged boolean, category string, sub_clause string, reasoning string"


def by_name(vendors: DataFrame) -> DataFrame:
    """Every vendor (``gstin, vendor_name``) with the rule that its name meets, without a model or a call."""
    pick = lambda place: F.coalesce(*(F.when(F.col("vendor_name").rlike(rule[0]), rule[place]) for rule in NAME_RULES))
    rows = vendors.withColumns({"category": pick(1), "sub_clause": pick(2)})
    why = F.when(F.col("category").isNotNull(), F.concat(F.lit("the name suggests: "), "category")).otherwise("no rule meets the name")
    return rows.select("gstin", "vendor_name", F.col("category").isNotNull().alias("flagged"), "category", "sub_clause", why.alias("reasoning"))


def wanted(blocked_rows: DataFrame) -> bool:
    """Screening is offered only where no row was flagged by its text."""
    return blocked_rows.isEmpty()


def screened(vendors: DataFrame, screen: Callable[[list[dict]], Iterable[dict]], batch: int = 200) -> tuple[DataFrame, DataFrame]:
    """Answers of an injected ``screen`` and the vendors that it left out.

    ``screen`` gets up to ``batch`` vendors at a time, in the tasks that hold them,
    and sees the tax id and the name only.  A malformed answer, one without an
    asked-for tax id, a flag or a reason, is dropped.  The answers are written
    once, so that nobody is asked twice.
    """

    def ask(frames):
        import pandas as pd

        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                asked = dict(zip(part["gstin"], part["vendor_name"], strict=True))
                found = {}
                for r in screen([{"gstin": g, "vendor_name": n} for g, n in asked.items()]):
                    if isinstance(r, dict) and r.get("gstin") in asked and isinstance(r.get("flagged"), bool) and isinstance(r.get("reasoning"), str):
                        texts = [r.get(k) if isinstance(r.get(k), str) else None for k in ("category", "sub_clause")]
                        found[r["gstin"]] = (r["gstin"], asked[r["gstin"]], r["flagged"], *texts, r["reasoning"])
                yield pd.DataFrame(list(found.values()), columns=["gstin", "vendor_name", "flagged", "category", "sub_clause", "reasoning"])

    results = staged(vendors.select("gstin", "vendor_name").mapInPandas(ask, RESULT), "screening")
    return results, vendors.join(results.select("gstin"), "gstin", "left_anti")
