"""Operator 12: how filters interact, from a histogram of failure masks.

Every document gets a mask with one bit for each filter that it fails, by native
expressions over its whole text; the last bit says that a smaller id has the same
text anywhere in the table.  What any order of the filters keeps and removes
follows from how many documents of a part have each mask, as does the Shapley
value: in ``n! / k`` of all orders a given one of the ``k`` filters that a
document fails comes first and removes it.  So the table is read once, and all
orders are read off at most ``2 ** n`` cells a part.

Scale: texts leave the scan as a SHA-256 digest and a mask.  Counting is done in
sums that are combined before each shuffle: rows of one digest, part, mask and
label keep their number, least id and the number of rows with it, and the least
of these per digest is joined back.  So a text that fills a third of the table,
or a part that does, is a few rows for each task and never a group in one of them.
Rows with a null id need no label and no digest; they are counted apart.

Cases: a null text is an empty one; a null part is the empty string; a null id is
neither smaller nor greater than any id, so its rows never fail as copies nor make
others fail; rows with equal ids and texts do not fail through each other; a
document with several label rows has a label if one of them says so, one without
any has none; very long texts are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workspace import scratch, written

WORD = r"([^\x20\x09-\x0D]+)"


@dataclass(frozen=True)
class Filter:
    """``fails``: a condition on ``text`` and its ``words``. Letters are single characters."""

    letter: str
    fails: Callable[[Column, Column], Column]


FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 50),
    Filter("B", lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)),
    Filter("C", lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text)),
    Filter("D", lambda text, words: text.rlike(r"[#$%&*|]")),
)
COPIES = "E"  #: The filter that fails copies of a smaller id


def failure_masks(docs: DataFrame, filters: Sequence[Filter] = FILTERS, part: str = "source") -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (bit ``i``: fails filter ``i``) and ``digest`` of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(1)).alias("words"))
    bits = [f.fails(F.col("text"), F.col("words")).cast("int") * (1 << i) for i, f in enumerate(filters)]
    return rows.select("doc_id", "part", sum(bits, F.lit(0)).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, part: str = "source") -> DataFrame:
    """One row for each part and mask that occurs: ``n``, ``good`` and ``toxic`` documents. The copies' bit follows those of ``filters``."""
    copy_bit = 1 << len(filters)
    masks = written(failure_masks(docs, filters, part), "audit-masks")
    nameless = masks.filter("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))

    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = masks.filter("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("rows"))
    rows = rows.join(marked, "doc_id", "left").fillna(False, ["is_good", "is_toxic"])
    alike = rows.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(F.sum("rows").alias("n"), F.min("doc_id").alias("first"), F.min_by("rows", "doc_id").alias("n_first"))
    alike = written(alike, "audit-alike")
    least = alike.groupBy("digest").agg(F.min("first").alias("least"))
    alike = alike.join(least, "digest").withColumn("n_first", F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(F.lit(0)))
    originals = alike.select("part", "mask", "is_good", "is_toxic", F.col("n_first").alias("n"))
    copies = alike.select("part", (F.col("mask") + copy_bit).alias("mask"), "is_good", "is_toxic", (F.col("n") - F.col("n_first")).alias("n"))
    named = originals.unionAll(copies).groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(f"is_{c}"), F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic")))
    return named.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def _orders(letters: Sequence[str]) -> Column:
    """All orders of the letters, as strings."""
    every = F.array(*map(F.lit, letters))
    found = F.array(F.lit(""))
    for _ in letters:
        found = F.flatten(F.transform(found, lambda head: F.transform(F.filter(every, lambda c: F.instr(head, c) == 0), lambda c: F.concat(head, c))))
    return found


def orders_of(histogram: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Every order and step for each part of a histogram as ``cells`` gives. A part has at most ``2 ** n`` cells."""
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.withColumn("filter_order", F.explode(_orders(letters))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))

    def bits(head: Column) -> Column:
        return sum((F.when(F.instr(head, c) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))

    order, step = F.col("filter_order"), F.col("step")
    steps = steps.withColumns({"own": bits(F.substring(order, step, F.lit(1))), "before": bits(F.substring(order, F.lit(1), step - 1))})
    own, before = F.col("own"), F.col("before")

    def total(value: Callable[[Column], Column], where: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda all_, cell: all_ + F.when(where(cell["mask"]), value(cell)).otherwise(F.lit(0)))

    def removed(mask: Column) -> Column:
        return (mask.bitwiseAND(own) != 0) & (mask.bitwiseAND(before) == 0)

    first_in = F.lit(math.factorial(len(letters)))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int"),
        total(lambda c: c["n"], lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: (c["n"] * first_in / F.bit_count(c["mask"])).cast("long"), lambda m: m.bitwiseAND(own) != 0).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, copies: str = COPIES, part: str = "source") -> DataFrame:
    """For each part, order of filters and step: what its filter keeps and removes, what it would remove besides, and its Shapley value times the number of orders."""
    letters = [*(f.letter for f in filters), copies]
    with scratch(docs.sparkSession):
        return written(orders_of(written(cells(docs, labels, filters, part), "audit-cells"), letters), "audit", keep=True)
