"""Invoice-level matching in tiers: exact numbers, ambiguous numbers, digit bridges, and three fallbacks.

Inputs are canonical invoice tables (``row_index, gstin, identifier,
taxable_value, igst, cgst, sgst, invoice_date``, amounts in paise).  Every tier
is an equi-join on the tax id and something narrower, and works on what the
tiers before it left over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers as ids
from ledgerloom.functions.amounts import days_between
from ledgerloom.operators.matching import banded, mutually_unique, taxes_agree
from ledgerloom.plans.fixed import TIEBREAK_DAYS, TOLERANCE
from ledgerloom.plans.staging import staged

KEY = ["gstin", "identifier"]
AMOUNTS = ["taxable_value", "igst", "cgst", "sgst"]
ROW = ["row_index", *KEY, *AMOUNTS, "invoice_date"]


def canonical(invoices: DataFrame) -> DataFrame:
    """Rows with a tax id; ids and numbers in comparable form, missing amounts zero."""
    rows = invoices.filter(F.trim("gstin") != "")
    return rows.select("row_index", F.upper(F.trim("gstin")).alias("gstin"), ids.identifier(F.col("identifier")).alias("identifier"), *(F.coalesce(a, F.lit(0)).alias(a) for a in AMOUNTS), "invoice_date")


def indexable(rows: DataFrame) -> DataFrame:
    return rows.filter("identifier <> ''")


def key_counts(rows: DataFrame, name: str) -> DataFrame:
    return indexable(rows).groupBy(*KEY).agg(F.count("*").alias(name))


def exact_pairs(gstr2a: DataFrame, books: DataFrame) -> DataFrame:
    """Invoices whose number stands exactly once on both sides."""
    a = indexable(gstr2a).groupBy(*KEY).agg(F.count("*").alias("n_a"), *(F.first(c).alias(f"a_{c}") for c in ("row_index", *AMOUNTS))).filter("n_a = 1")
    b = indexable(books).groupBy(*KEY).agg(F.count("*").alias("n_b"), *(F.first(c).alias(f"b_{c}") for c in ("row_index", *AMOUNTS))).filter("n_b = 1")
    return a.join(b, KEY).drop("n_a", "n_b")


def _on_both(one: DataFrame, two: DataFrame) -> DataFrame:
    """Numbers of either side, and how often each stands there: ``n_one``, ``n_two`` (0 if not at all)."""
    sides = indexable(one).select(*KEY, F.lit(1).alias("first"), F.lit(0).alias("second")).unionByName(indexable(two).select(*KEY, F.lit(0).alias("first"), F.lit(1).alias("second")))
    return sides.groupBy(*KEY).agg(F.sum("first").alias("n_one"), F.sum("second").alias("n_two"))


def bridged(keys: DataFrame) -> DataFrame:
    """``gstin, identifier, over_one, over_two``: for numbers of ``_on_both`` that stand on side one (two) alone, the number of the other side that spells it otherwise, or null.

    A plain number bridges to the only identifier over there with that run of three
    digits or more; another identifier to the only plain number that is one of its
    runs, if no second identifier on its own side has that run.  Holders of a run are
    counted, and the least kept, before the shuffle; runs that several numbers of both
    sides hold (a year), or that no number of one side alone shares with the other side,
    bridge nothing and go before the join back.
    """
    runs = keys.withColumn("run", F.explode(F.array_distinct(ids.digit_runs(F.col("identifier"), ids.SHORTEST_RUN))))
    runs = runs.withColumn("plain", F.col("identifier").rlike(r"^\d+$"))
    on = {"one": F.col("n_one") > 0, "two": F.col("n_two") > 0}
    alone = {"one": on["one"] & ~on["two"], "two": on["two"] & ~on["one"]}
    sums = [F.count_if(here).alias(f"n_{side}_alone") for side, here in alone.items()]
    for side, there in on.items():
        for kind, held in (("run", there), ("plain", there & F.col("plain"))):
            sums += [F.count_if(held).alias(f"n_{side}_{kind}"), F.min(F.when(held, F.col("identifier"))).alias(f"{side}_{kind}")]
    holders = runs.groupBy("gstin", "run").agg(*sums).filter("(n_one_run = 1 or n_two_run = 1) and (n_one_alone > 0 and n_two_run > 0 or n_two_alone > 0 and n_one_run > 0)")
    runs = runs.filter(alone["one"] | alone["two"]).join(holders, ["gstin", "run"])
    partners = {}
    for own, other in (("one", "two"), ("two", "one")):
        by_plain = F.when(F.col("plain") & (F.col(f"n_{other}_run") == 1), F.col(f"{other}_run"))
        by_run = F.when(~F.col("plain") & (F.col(f"n_{own}_run") == 1) & (F.col(f"n_{other}_plain") == 1), F.col(f"{other}_plain"))
        partners[own] = F.when(alone[own], F.coalesce(by_plain, by_run))
    found = runs.select(*KEY, partners["one"].alias("one"), partners["two"].alias("two")).filter("one is not null or two is not null")
    only = lambda side: F.when(F.min(side) == F.max(side), F.min(side)).alias(f"over_{side}")
    return found.groupBy(*KEY).agg(only("one"), only("two"))


def digit_bridges(own: DataFrame, other: DataFrame) -> DataFrame:
    """``gstin, identifier, other_identifier``: numbers missing on the other side that one number there spells otherwise (``bridged``)."""
    return bridged(_on_both(own, other)).filter("over_one is not null").select(*KEY, F.col("over_one").alias("other_identifier"))


def numbers(one: DataFrame, two: DataFrame) -> DataFrame:
    """Numbers of both sides with their counts and bridges, for ``unmatched``; those that stand once on each side are settled and left out."""
    keys = _on_both(one, two)
    return keys.filter("n_one <> 1 or n_two <> 1").join(bridged(keys), KEY, "left")


def _left(rows: DataFrame, other: DataFrame, keys: DataFrame, own_side: str, other_side: str, excluded: DataFrame | None) -> DataFrame:
    n_own, n_other = F.col(f"n_{own_side}"), F.col(f"n_{other_side}")
    here = keys.filter((n_own > 0) & F.when(n_other == 0, F.col(f"over_{own_side}").isNull()).otherwise((n_own > 1) | (n_other > 1)))
    rows = indexable(rows).join(here.select(*KEY, (n_other > 0).alias("ambiguous")), KEY)
    ambiguous = rows.filter("ambiguous").select(*ROW)
    partner = indexable(other).join(here.filter(n_other > 0).select(*KEY), KEY, "left_semi")
    agree = banded(ambiguous, partner.select(*ROW), KEY, "taxable_value", TOLERANCE).filter(taxes_agree(TOLERANCE))
    left = rows.join(agree.select(F.col("l_row_index").alias("row_index")).distinct(), "row_index", "left_anti").select(*ROW)
    return left if excluded is None else left.join(excluded.select("row_index"), "row_index", "left_anti")


def unmatched(own: DataFrame, other: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows of ``own`` that exact numbers, amounts under ambiguous numbers, and digit bridges leave over.

    ``excluded``: row indexes that are never reported but can serve the other side as partners.
    """
    return _left(own, other, numbers(own, other), "one", "two", excluded)


def unmatched_on_both(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unmatched`` of either side; numbers are counted and bridged once for both."""
    keys = staged(numbers(one, two), "numbers")
    return _left(one, two, keys, "one", "two", None), _left(two, one, keys, "two", "one", None)


def _pairs_by_short_number(a: DataFrame, b: DataFrame) -> DataFrame:
    """Plain numbers equal but for leading zeros, amounts and dates close."""
    keyed = [side.withColumn("number", ids.plain_number(F.col("identifier"))).filter("number is not null") for side in (a, b)]
    pairs = banded(*keyed, ["gstin", "number"], "taxable_value", TOLERANCE)
    return pairs.filter(days_between(F.col("l_invoice_date"), F.col("r_invoice_date")) <= TIEBREAK_DAYS)


def _number_keys(rows: DataFrame, cut_short: bool) -> DataFrame:
    """Rows under ``number_key``: the number as normalized, and for each of its core segments those before it with the segment (``cut_short``: with each start of it).

    ``whole``: the key takes in all segments.
    """
    core = ids.core_segments(F.col("identifier"))
    place = lambda k: F.concat(k.cast("string"), F.lit("\n"), F.array_join(F.slice(F.col("core"), F.lit(1), k - 1), "\n"), F.lit("\n"))

    def keys_at(k: Column) -> Column:
        part = F.get("core", k - 1)
        parts = F.transform(F.sequence(F.lit(1), F.length(part)), lambda n: F.substring(part, F.lit(1), n)) if cut_short else F.array(part)
        return F.transform(parts, lambda x: F.struct(F.concat(place(k), x).alias("number_key"), (k == F.size("core")).alias("whole")))

    places = F.when(F.size("core") > 0, F.sequence(F.lit(1), F.size("core"))).otherwise(F.array().cast("array<int>"))
    normal = F.array(F.struct(F.concat(F.lit("="), ids.normalized_number(F.col("identifier"))).alias("number_key"), F.lit(True).alias("whole")))
    keyed = rows.withColumn("core", core).withColumn("key", F.explode(F.concat(normal, F.flatten(F.transform(places, keys_at)))))
    return keyed.select(*rows.columns, "key.number_key", "key.whole")


def _with_amount_beside(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows whose vendor has an amount like theirs on the other side. Amounts there are made distinct first, so none makes pairs."""
    bucket = F.floor(F.col("taxable_value") / TOLERANCE).cast("long")
    near = other.select("gstin", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")).distinct()
    return rows.withColumn("bucket", bucket).join(near, ["gstin", "bucket"], "left_semi").drop("bucket")


def _pairs_by_normalized_number(a: DataFrame, b: DataFrame, few: int = 16) -> DataFrame:
    """Amounts and taxes agree, and the numbers may be one.

    Rows with ``few`` amounts beside theirs on the other side, or less, are compared with
    these.  For others the numbers have to meet first.  Numbers that may be one are equal
    as normalized, or equal in all segments that the one of fewer has, where the last of
    them may be cut short in either.  So one has a key that is, start for start, a key of
    the other, and one of the two keys is whole: numbers that cannot be one do not meet,
    however often a vendor has one amount.
    """
    bucket = F.floor(F.col("taxable_value") / TOLERANCE).cast("long")
    near = b.select("gstin", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")).groupBy("gstin", "bucket").agg(F.count("*").alias("partners"))
    beside = staged(a.withColumn("bucket", bucket).join(near, ["gstin", "bucket"]), "amounts-beside")
    some, many = beside.filter(F.col("partners") <= few).select(*a.columns), beside.filter(F.col("partners") > few).select(*a.columns)
    pairs = banded(some, b, ["gstin"], "taxable_value", TOLERANCE).filter(taxes_agree(TOLERANCE))
    if not many.isEmpty():
        there = staged(_with_amount_beside(b, many), "amounts-beside")
        found = []
        for short, full, sides in ((many, there, "lr"), (there, many, "rl")):
            met = banded(_number_keys(short, True), _number_keys(full, False), ["gstin", "number_key"], "taxable_value", TOLERANCE)
            met = met.filter(taxes_agree(TOLERANCE) & (F.col("l_whole") | F.col("r_whole")))
            found.append(met.select(*(F.col(f"{'lr'[sides.index(side)]}_{name}").alias(f"{side}_{name}") for side in "lr" for name in a.columns)))
        pairs = pairs.unionByName(found[0].unionByName(found[1]).dropDuplicates(["l_row_index", "r_row_index"]))
    for side in "lr":
        number = F.col(f"{side}_identifier")
        pairs = pairs.withColumns({f"{side}_core": ids.core_segments(number), f"{side}_norm": ids.normalized_number(number)})
    names = [F.col(f"{side}_{name}") for name in ("identifier", "core", "norm") for side in "lr"]
    return pairs.filter(ids.numbers_agree(*names)).drop("l_core", "r_core", "l_norm", "r_norm")


def _pairs_by_month(a: DataFrame, b: DataFrame) -> DataFrame:
    """Amounts and taxes agree within one calendar month; rows without a date meet nothing."""
    a, b = (side.withColumn("month", F.date_trunc("month", "invoice_date")) for side in (a, b))
    return banded(a, b, ["gstin", "month"], "taxable_value", TOLERANCE).filter(taxes_agree(TOLERANCE)).drop("l_month", "r_month")


@dataclass(frozen=True)
class Extras:
    """What is left on either side, and the pairs each tier found on the way."""

    extra_in_2a: DataFrame
    extra_in_books: DataFrame
    short_numbers: DataFrame
    normalized_numbers: DataFrame
    possible_matches: DataFrame
    numbers: DataFrame

    def bridges(self) -> DataFrame:
        """``digit_bridges`` of the statement's numbers, which all tiers know already."""
        return self.numbers.filter("over_one is not null").select(*KEY, F.col("over_one").alias("other_identifier"))


def _without(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return rows.join(pairs.select(F.col(f"{side}_row_index").alias("row_index")), "row_index", "left_anti")


def detect_extras(gstr2a: DataFrame, books: DataFrame, excluded_2a: DataFrame | None = None, excluded_books: DataFrame | None = None) -> Extras:
    """All tiers. What a tier leaves is written down before the next reads it, so plans do not pile up. Both inputs are read several times."""
    a0, b0 = canonical(gstr2a), canonical(books)
    keys = staged(numbers(a0, b0), "numbers")
    a, b = staged(_left(a0, b0, keys, "one", "two", excluded_2a), "left-2a"), staged(_left(b0, a0, keys, "two", "one", excluded_books), "left-books")
    short = staged(mutually_unique(_pairs_by_short_number(a, b), "l_row_index", "r_row_index"), "short-numbers")
    a, b = _without(a, short, "l"), _without(b, short, "r")
    normalized = staged(mutually_unique(_pairs_by_normalized_number(a, b), "l_row_index", "r_row_index"), "normalized-numbers")
    a, b = _without(a, normalized, "l"), _without(b, normalized, "r")

    def with_blanks(rows: DataFrame, all_rows: DataFrame, excluded: DataFrame | None) -> DataFrame:
        blank = all_rows.filter("identifier = ''")
        return rows.unionByName(blank if excluded is None else blank.join(excluded.select("row_index"), "row_index", "left_anti"))

    candidates = with_blanks(a, a0, excluded_2a), with_blanks(b, b0, excluded_books)
    possible = staged(mutually_unique(_pairs_by_month(*candidates), "l_row_index", "r_row_index"), "possible")
    blank_a, blank_b = F.col("l_identifier") == "", F.col("r_identifier") == ""
    reason = (
        F.when(blank_a & blank_b, "numbers blank on both sides").when(blank_b, "number blank in the books").when(blank_a, "number blank in the statement").otherwise("numbers differ")
    )
    return Extras(_without(a, possible, "l"), _without(b, possible, "r"), short, normalized, possible.withColumn("reason", reason), keys)
