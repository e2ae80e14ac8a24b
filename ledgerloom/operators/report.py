"""The netted credit summary, ranked issues, report tables and their reviewers' notes.

A ``Proposal`` changes nothing: its steps are staged in the shared folder while
it is made, and no report is written until ``accept``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.amounts import breakdown_text
from ledgerloom.operators import duplicates, invoices, row_rules, screening, vendors
from ledgerloom.plans.fixed import MATERIALITY
from ledgerloom.plans.staging import exists, staged


def tax_of(prefix: str = "") -> Column:
    return sum((F.coalesce(f"{prefix}{h}", F.lit(0)) for h in ("igst", "cgst", "sgst")), start=F.lit(0).cast("long"))


@dataclass(frozen=True)
class Proposal:
    """All findings of one reconciliation. Rules that look at one sheet alone have run on both; ``source`` says on which. Duplicates are looked for when they are first asked for."""

    gstr2a: DataFrame
    books: DataFrame
    vendors: DataFrame
    extras: invoices.Extras
    wrong_head: DataFrame
    cross_wrong_head: DataFrame
    rcm_2a: DataFrame
    rcm_books: DataFrame
    blocked: DataFrame
    rate_mismatch: DataFrame
    limits: duplicates.Limits

    @cached_property
    def duplicates(self) -> DataFrame:
        return duplicates.on_both_sides(self.gstr2a, self.books, self.limits)


def propose(gstr2a: DataFrame, books: DataFrame, book_text: bool | None = None, statement_text: bool | None = None, limits: duplicates.Limits = duplicates.USUAL) -> Proposal:
    """Reverse charge is found first: its rows never count as extras.

    ``book_text``, ``statement_text``: whether a side's particulars describe what was bought (judged if None).
    """
    usable = row_rules.describe(books).usable if book_text is None else book_text
    usable_2a = row_rules.describe(gstr2a).usable if statement_text is None else statement_text
    rcm_2a, rcm_books = (staged(row_rules.reverse_charge(side, description=text), "reverse-charge") for side, text in ((gstr2a, usable_2a), (books, usable)))
    extras = invoices.detect_extras(gstr2a, books, rcm_2a.select("row_index"), rcm_books.select("row_index"))

    def both(one: DataFrame, other: DataFrame) -> DataFrame:
        return one.withColumn("source", F.lit("gstr2a")).unionByName(other.withColumn("source", F.lit("books")))

    return Proposal(
        gstr2a,
        books,
        vendors.compare(gstr2a, books),
        extras,
        row_rules.wrong_head(gstr2a),
        row_rules.cross_wrong_head(gstr2a, books, extras.bridges()),
        rcm_2a,
        rcm_books,
        both(row_rules.blocked_credit(gstr2a, usable_2a), row_rules.blocked_credit(books, usable)),
        both(row_rules.rate_mismatch(gstr2a), row_rules.rate_mismatch(books)),
        limits,
    )


def summary(p: Proposal) -> DataFrame:
    """One row of counts and paise. Blocked credit and confirmed duplicates in the books are netted; the rest informs."""
    least = sum((F.least(f"a_{h}", f"b_{h}") for h in ("igst", "cgst", "sgst")), start=F.lit(0).cast("long"))
    gap = F.abs(tax_of("a_") - tax_of("b_"))
    differs = F.col("status") == "discrepancy"
    total = p.vendors.agg(
        F.count("*").alias("vendors"),
        F.coalesce(F.sum(tax_of("a_")), F.lit(0)).alias("tax_2a"),
        F.coalesce(F.sum(tax_of("b_")), F.lit(0)).alias("tax_books"),
        F.coalesce(F.sum(least), F.lit(0)).alias("supportable"),
        F.count_if(differs).alias("mismatches"),
        F.coalesce(F.sum(F.when(differs, gap)), F.lit(0)).alias("mismatch_amount"),
        *(F.count_if(F.col("status") == status).alias(f"vendors_{status}") for status in ("matched", "missing_in_books", "missing_in_gstr2a")),
    )

    def counted(rows: DataFrame, name: str, amount: Column) -> DataFrame:
        return rows.agg(F.count("*").alias(f"{name}_rows"), F.coalesce(F.sum(amount), F.lit(0)).alias(f"{name}_amount"))

    parts = [
        counted(p.extras.extra_in_2a, "extra_in_2a", tax_of()),
        counted(p.extras.extra_in_books, "extra_in_books", tax_of()),
        counted(p.extras.possible_matches, "possible_match", tax_of("l_")),
        counted(p.blocked, "blocked", tax_of()),
        counted(duplicates.overclaim(p.duplicates).filter("confirmed and source = 'books'"), "duplicate", F.col("overclaim")),
        counted(p.wrong_head, "wrong_head", tax_of()),
        p.cross_wrong_head.agg(F.count("*").alias("cross_wrong_head_rows")),
        counted(p.rcm_2a.select("igst", "cgst", "sgst").unionByName(p.rcm_books.select("igst", "cgst", "sgst")), "rcm", tax_of()),
        counted(p.rate_mismatch, "rate_mismatch", F.abs("difference")),
    ]
    for part in parts:  # one row each
        total = total.crossJoin(part)
    return total.withColumn("net_eligible", F.col("supportable") - F.col("blocked_amount") - F.col("duplicate_amount"))


def summary_lines(one_row: DataFrame) -> DataFrame:
    """The summary as label and value, one line each."""
    names = one_row.columns
    return one_row.select(F.expr(f"stack({len(names)}, {', '.join(f'''{chr(39)}{n}{chr(39)}, cast({n} as bigint)''' for n in names)}) as (label, value)"))


def top_issues(p: Proposal) -> DataFrame:
    """All findings as ``tier, amount, category, reason, gstin, row_index, breakdown`` (of the tax, if it has several heads). Tier 1: reverse charge and blocked credit of 1 % of the statement's tax or more."""
    return _issues(_with_heads(p) | {"duplicates": p.duplicates, "rate_mismatch": p.rate_mismatch}, _bar(p))


def issues_by_head(p: Proposal) -> DataFrame:
    """Those of ``top_issues`` that have a breakdown. Findings that never have one are not computed."""
    return _issues(_with_heads(p), _bar(p)).filter("breakdown is not null")


def _bar(p: Proposal) -> DataFrame:
    return p.gstr2a.agg((F.coalesce(F.sum(tax_of()), F.lit(0)) * MATERIALITY).alias("bar"))


def ranked_from_written(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """The same issues from tables that ``accept`` wrote, without computing anything anew; the bar comes from the written summary."""
    found = {name: spark.read.parquet(place) for name, place in places.items()}
    bar = found["summary"].filter("label = 'tax_2a'").select((F.col("value") * MATERIALITY).alias("bar"))
    return ranked(_issues(found, bar))


def _issues(t: dict[str, DataFrame], bar: DataFrame) -> DataFrame:
    def issue(rows: DataFrame, category: str | Column, reason: Column, tier: int, amount: Column, row: str = "row_index", heads: str | None = "") -> DataFrame:
        parts = F.lit(None).cast("string") if heads is None else breakdown_text(*(F.coalesce(f"{heads}{h}", F.lit(0)) for h in ("igst", "cgst", "sgst")))
        return rows.select(F.lit(tier).alias("tier"), amount.cast("long").alias("amount"), (F.lit(category) if isinstance(category, str) else category).alias("category"), reason.alias("reason"), "gstin", F.col(row).cast("long").alias("row_index"), parts.alias("breakdown"))

    gap = F.abs(tax_of("a_") - tax_of("b_"))
    heads = F.concat_ws(" ", F.lit("charged"), "actual", F.lit("should be"), "expected")
    found = [
        issue(t["extra_in_books"], "Extra in Books", F.lit("not in the statement yet"), 2, tax_of()),
        issue(t["extra_in_2a"], "Extra in 2A", F.lit("not in the books yet"), 2, tax_of()),
        issue(t["possible_matches"].withColumn("gstin", F.col("l_gstin")), "Possible Match", F.col("reason"), 3, tax_of("l_"), "l_row_index", "l_"),
        issue(t["mismatch"].withColumn("row_index", F.lit(None)), "Mismatch", F.lit("tax totals differ"), 2, gap, heads="a_"),
        issue(t["wrong_head"].filter("section = 'statement'"), "Wrong Head", heads, 3, tax_of()),
    ]
    if "duplicates" in t:
        doubles = duplicates.overclaim(t["duplicates"])
        size = F.concat(F.lit("cluster "), F.col("number"), F.lit(" of "), F.col("members"), F.lit(" entries in "), F.col("source"))
        category = F.when(F.col("confirmed"), "Duplicate Invoices").otherwise("Possible Duplicate Invoices")
        found.append(issue(doubles, category, size, 3, F.col("overclaim"), "cluster", None))
    if "rate_mismatch" in t:
        found.append(issue(t["rate_mismatch"], "Rate Mismatch", F.concat_ws(" ", F.lit("tax is off at"), F.col("rate_percent"), F.lit("percent")), 3, F.abs("difference"), heads=None))
    weighed = [issue(t["rcm"], "RCM", F.coalesce("category", "found_by"), 0, tax_of()), issue(t["ineligible_itc"], "Ineligible ITC", F.concat_ws(" ", "category", "section"), 0, tax_of())]
    material = weighed[0].unionByName(weighed[1]).crossJoin(F.broadcast(bar))  # one row
    found.append(material.withColumn("tier", F.when(F.col("amount") >= F.col("bar"), 1).otherwise(3)).drop("bar"))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def flags_by_category(issues: DataFrame) -> DataFrame:
    """``category, items, amount``: what is open in each category."""
    return issues.groupBy("category").agg(F.count("*").alias("items"), F.sum("amount").alias("amount"))


def ranked(issues: DataFrame, most: int | None = None) -> DataFrame:
    """By tier, then amount; category, tax id and row break ties. A limit makes it a top-k, without a full sort."""
    order = issues.orderBy("tier", F.desc("amount"), "category", "gstin", "row_index", "reason")
    return order if most is None else order.limit(most)


def _in_place(rows: DataFrame, notes: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Both with ``met`` and ``nth``, which a note and its row have in common: a note goes to the row of its key that stands where its own row stood, others to the rows of their key that are left, in turn."""
    at = list(dict.fromkeys([*keys, order]))
    again = lambda df: df.withColumn("again", F.row_number().over(Window.partitionBy(*at).orderBy(order)))

    def marked(own: DataFrame, other: DataFrame) -> DataFrame:
        there = other.select(*(F.col(c).alias(f"at_{c}") for c in (*at, "again")), F.lit(True).alias("met"))
        same = F.col("again") == F.col("at_again")
        for c in at:
            same = same & F.col(c).eqNullSafe(F.col(f"at_{c}"))
        found = own.join(there, same, "left").withColumn("met", F.col("met").isNotNull()).drop("again", *(f"at_{c}" for c in (*at, "again")))
        return found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "met").orderBy(order)))

    rows, notes = again(rows), again(notes)
    return marked(rows, notes), marked(notes, rows)


def _same_place(other: str, keys: list[str]) -> Column:
    match = (F.col("met") == F.col(f"{other}_met")) & (F.col("nth") == F.col(f"{other}_nth"))
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"{other}_{key}"))
    return match


def carry_notes(rows: DataFrame, notes: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    """``rows`` with the reviewer status and note of the old table's row with the same key, of several that with the same ``order`` if there is one; an old note is used once."""
    new, old = _in_place(rows, notes, keys, order)
    places = [*keys, "met", "nth"]
    old = old.select(*(F.col(c).alias(f"old_{c}") for c in places), "reviewer_status", "reviewer_note")
    return new.join(old, _same_place("old", keys), "left").drop("met", "nth", *(f"old_{c}" for c in places))


def orphaned_notes(rows: DataFrame, notes: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    """Old notes whose row is gone: those that ``carry_notes`` found no place for."""
    new, old = _in_place(rows, notes, keys, order)
    here = new.select(*(F.col(c).alias(f"new_{c}") for c in (*keys, "met", "nth")))
    return old.join(here, _same_place("new", keys), "left_anti").drop("met", "nth")


def _with_heads(p: Proposal) -> dict[str, DataFrame]:
    """The report tables whose rows have tax by head."""
    return {
        "extra_in_books": p.extras.extra_in_books,
        "extra_in_2a": p.extras.extra_in_2a,
        "possible_matches": p.extras.possible_matches,
        "mismatch": p.vendors.filter("status = 'discrepancy'"),
        "wrong_head": p.wrong_head.withColumn("section", F.lit("statement")).unionByName(p.cross_wrong_head.withColumn("section", F.lit("both sides")), allowMissingColumns=True),
        "rcm": p.rcm_2a.withColumn("source", F.lit("gstr2a")).unionByName(p.rcm_books.withColumn("source", F.lit("books"))),
        "ineligible_itc": p.blocked,
    }


def tables(p: Proposal, suggestions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ten report tables; with ``suggestions`` (what ``screening`` says of vendors) an eleventh, of the flagged ones, if no row was found ineligible by its text."""
    found = {"summary": summary_lines(summary(p)), **_with_heads(p), "duplicates": p.duplicates, "rate_mismatch": p.rate_mismatch}
    if suggestions is not None and screening.wanted(p.blocked):
        found["vendor_suggestions"] = suggestions.filter("flagged")
    return found


#: What makes a row of a report table the same as one of an older report, and what orders rows that are alike.
REVIEWED: dict[str, tuple[list[str], str]] = {
    "extra_in_books": (["gstin", "identifier"], "row_index"),
    "extra_in_2a": (["gstin", "identifier"], "row_index"),
    "possible_matches": (["l_gstin", "l_identifier", "r_identifier"], "l_row_index"),
    "mismatch": (["gstin"], "gstin"),
    "wrong_head": (["section", "gstin", "identifier"], "row_index"),
    "rcm": (["source", "gstin", "identifier"], "row_index"),
    "ineligible_itc": (["source", "gstin", "identifier"], "row_index"),
    "duplicates": (["source", "gstin", "identifier"], "row_index"),
    "rate_mismatch": (["source", "gstin", "identifier"], "row_index"),
    "vendor_suggestions": (["gstin"], "gstin"),
}
_NOTED = "reviewer_status is not null or reviewer_note is not null"


def written_notes(spark: SparkSession, name: str, place: str, orphans: str) -> DataFrame | None:
    """What reviewers wrote beside rows of the table at ``place``, and what is kept at ``orphans`` of rows that were gone before; None if nothing was ever written there."""
    keys, order = REVIEWED[name]
    columns = [*dict.fromkeys([*keys, order]), "reviewer_status", "reviewer_note"]
    found = [spark.read.parquet(at).filter(_NOTED).select(*columns) for at in (place, orphans) if exists(spark, at)]
    if not found:
        return None
    return staged(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "notes")  # both are about to be replaced


def accept(p: Proposal, path: str, suggestions: DataFrame | None = None) -> dict[str, str]:
    """Write all report tables below ``path``, explained, in place of older ones whose reviewers' notes they take over; gives each table's place.

    Notes on rows that are gone are kept below ``path/orphaned`` (``orphans``), and come back with their row.
    """
    from ledgerloom.operators.explain import explained  # explains the tables of this module

    places = {}
    for name, rows in tables(p, suggestions).items():
        place = places[name] = f"{path.rstrip('/')}/{name}"
        if name in REVIEWED:
            keys, order = REVIEWED[name]
            rows, orphans = explained(name, rows), f"{path.rstrip('/')}/orphaned/{name}"
            notes = written_notes(rows.sparkSession, name, place, orphans)
            if notes is None:
                rows = rows.withColumns({"reviewer_status": F.lit(None).cast("string"), "reviewer_note": F.lit(None).cast("string")})
            else:
                orphaned_notes(rows, notes, keys, order).write.mode("overwrite").parquet(orphans)
                rows = carry_notes(rows, notes, keys, order)
        rows.write.mode("overwrite").parquet(place)
    return places


def orphans(spark: SparkSession, path: str) -> DataFrame:
    """``report_table, row_key, reviewer_status, reviewer_note`` of all notes below ``path`` whose row is gone."""
    parts = []
    for name, (keys, _) in REVIEWED.items():
        if exists(spark, place := f"{path.rstrip('/')}/orphaned/{name}"):
            key = F.concat_ws("|", *(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys))
            parts.append(spark.read.parquet(place).select(F.lit(name).alias("report_table"), key.alias("row_key"), "reviewer_status", "reviewer_note"))
    empty = spark.createDataFrame([], "report_table string, row_key string, reviewer_status string, reviewer_note string")
    for part in parts:
        empty = empty.unionByName(part)
    return empty


def note_counts(spark: SparkSession, path: str) -> DataFrame:
    """``report_table, carried, orphaned``: notes that stand beside a row, and those whose row is gone."""
    gone = orphans(spark, path).select("report_table", F.lit(0).alias("carried"), F.lit(1).alias("orphaned"))
    for name in REVIEWED:
        if exists(spark, place := f"{path.rstrip('/')}/{name}"):
            gone = gone.unionByName(spark.read.parquet(place).filter(_NOTED).select(F.lit(name).alias("report_table"), F.lit(1).alias("carried"), F.lit(0).alias("orphaned")))
    return gone.groupBy("report_table").agg(F.sum("carried").alias("carried"), F.sum("orphaned").alias("orphaned"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Add ``rows`` (time, place, text) to the audit log; older entries stay as they are."""
    rows.write.mode("append").parquet(path)


def audit_count(spark: SparkSession, path: str) -> int:
    """Entries of the audit log; none if nothing was ever logged."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0
