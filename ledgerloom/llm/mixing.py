"""Operator 7 (native): mix sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time ``t`` from 0 to 1.  Its
demand is the integral of the schedule: ``D(t) = target * ((1 - slope) * t +
slope * t**2)``, which is ``target`` at the end.  A source's documents stand in
a fixed shuffled order; the words before a document are its cumulative demand,
and inverting ``D`` there gives the document's training position.  The mix is
range-sorted by that position.

Targets: the source's share, by weight, of ``total_share`` times all words; no
target exceeds ``max_repeat`` times its source's words, and what is cut off is
shared among the others by weight until none is above.  With the sources in
ascending order of ``cap / weight`` this is a running sum, not a loop.

Copies: a source of ``S`` words and target ``T`` is read over from its start
until ``T`` words are taken; the document at the end of the last pass is taken
in part.  So a document gives between 0 and ``max_repeat`` times its words, and
each source gives its target to the word.

Scale: the running sum within a source is split. Rows are dealt to ``16 **
digits`` buckets by the first hexadecimal digits of their order key, buckets
are summed before the shuffle, a running sum over bucket totals gives each
bucket its start, and only rows of one bucket are ever sorted together.  The
number of digits follows the number of rows, so buckets stay near
``rows_per_bucket`` rows whatever share of the table a source holds.

Cases: a null or empty text has size 0 and nothing is taken from it; a null
source is a source of its own, the last; rows with equal ids and texts each get
their own share, in no particular order among themselves; an empty table gives
no rows.  Columns of the input that are not named here are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.workspace import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights go to sources in ascending order and repeat.
WEIGHTS = (5, 2, 1)
#: How a source's weight changes over training, in the same order: from 1 - slope to 1 + slope times its mean.
SLOPES = (-0.5, 0.0, 0.5)


def _cyclic(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, total_share: float = 1.5, max_repeat: int = 2, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """One row per source: its words, weight, slope and target."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumns({"weight": _cyclic(weights, F.col("rank")), "slope": _cyclic(slopes, F.col("rank")), "cap": F.col("source_size") * max_repeat})
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.sum("source_size").over(everything) * F.lit(total_share)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onwards = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onwards))
    # The first source whose cap is not reached sets the water level; those after it would only give lower ones.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("water", F.max(free).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("source", "source_size", "slope", target.alias("target"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """Row key, words and order key of every document; the text itself is left behind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order_key"),
    )


def mix(sizes: DataFrame, total_share: float = 1.5, max_repeat: int = 2, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, rows_per_bucket: int = 4096) -> DataFrame:
    """What the mix takes of every document. ``sizes``: from ``document_sizes``.

    Adds ``source_size``, ``target``, ``passes`` (whole copies), ``rest`` (words of
    one copy more), ``taken`` and ``position`` (0 to 1; null if nothing is taken).
    """
    sizes = written(sizes, "mix-sizes")
    targets = written(source_targets(sizes, total_share, max_repeat, weights, slopes), "mix-targets")
    digits = max(1, math.ceil(math.log(max(1, sizes.count() / rows_per_bucket), 16)))
    rows = sizes.withColumn("bucket", F.substring("order_key", 1, digits))

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "source_size", "target", "slope")

    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket"))).select("r.*", "bucket_start", "source_size", "target", "slope")

    words_before = F.col("bucket_start") + F.col("in_bucket")
    wanted = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    rows = rows.withColumns({"words_before": words_before, "whole": whole})
    past = wanted - F.col("whole") * F.col("source_size")
    in_last = F.greatest(F.lit(0), F.least(F.col("size"), past - F.col("words_before")))
    full = F.col("whole") + (in_last == F.col("size")).cast("long")
    rows = rows.withColumns({"passes": F.when(F.col("size") == 0, F.lit(0)).otherwise(full), "rest": F.when(in_last < F.col("size"), in_last).otherwise(F.lit(0))})
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))

    share = F.try_divide(F.col("words_before").cast("double"), F.col("target"))
    flat = 1 - F.col("slope")
    inverse = F.when(F.col("slope") == 0, share).otherwise((F.sqrt(flat * flat + 4 * F.col("slope") * share) - flat) / (2 * F.col("slope")))
    return rows.withColumn("position", F.when(F.col("taken") > 0, F.least(F.abs(inverse), F.lit(1.0)))).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "slope", "passes", "rest", "taken", "words_before", "position"
    )


def _row_key(text_key: Column | None = None) -> Column:
    """One key for what makes a row: its id, source and text. Nulls are values of their own."""
    parts = [F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("text_key").cast("string") if text_key is None else text_key.cast("string")]
    return F.md5(F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), part), F.lit("-")) for part in parts)).cast("binary"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed training set: the rows of ``docs``, repeated, cut and range-sorted by position.

    Each copy of a document has the position that its own words are due at.  The
    document that a last pass ends in is cut after its last word taken.
    """
    plan = mix(document_sizes(docs), **options).filter("taken > 0")
    plan = plan.select(_row_key().alias("__mix_plan_key"), "passes", "rest", "words_before", "source_size", "target", "slope")
    plan = plan.toDF(*(name if name.startswith("__") else f"__mix_{name}" for name in plan.columns))
    same = Window.partitionBy("__mix_plan_key").orderBy("__mix_words_before")
    plan = plan.withColumn("__mix_plan_twin", F.row_number().over(same))
    keyed = docs.withColumn("__mix_key", _row_key(F.xxhash64(F.coalesce("text", F.lit("")))))
    keyed = keyed.withColumn("__mix_twin", F.row_number().over(Window.partitionBy("__mix_key").orderBy(F.lit(0))))
    # A difference, not an equality of twins: then rows stay where the window's shuffle by key has put them.
    joined = keyed.join(plan, (F.col("__mix_key") == F.col("__mix_plan_key")) & (F.col("__mix_twin") - F.col("__mix_plan_twin") == 0))
    slope = F.col("__mix_slope")
    copies = F.sequence(F.lit(1), (F.col("__mix_passes") + (F.col("__mix_rest") > 0).cast("long")).cast("int"))
    joined = joined.withColumn("__mix_copy", F.explode(copies))
    share = F.least(F.try_divide((F.col("__mix_words_before") + (F.col("__mix_copy") - 1) * F.col("__mix_source_size")).cast("double"), F.col("__mix_target")), F.lit(1.0))
    flat = 1 - slope
    position = F.when(slope == 0, share).otherwise((F.sqrt(flat * flat + 4 * slope * share) - flat) / (2 * slope))
    text = F.coalesce("text", F.lit(""))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("__mix_rest").cast("int")), " ")
    partly = F.col("__mix_copy") > F.col("__mix_passes")
    out = {"text": F.when(partly, cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(partly, F.length(cut).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(out).withColumn("__mix_position", position).orderBy("__mix_position", "doc_id", "__mix_copy").select(*docs.columns)
