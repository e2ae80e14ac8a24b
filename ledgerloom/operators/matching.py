"""Matching building blocks: band joins inside an equality key, and pairs that are each other's only choice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.identifiers import similarity_percent
from ledgerloom.plans.staging import staged


def banded(left: DataFrame, right: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Pairs with equal ``keys`` and ``value`` at most ``width`` apart, as an equi-join.

    The value's bucket is ``floor(value / width)``; each right row stands in its own
    bucket and both beside it, so close values always meet, and exactly once.
    Columns come out as ``l_`` and ``r_`` plus their names.
    """
    width_ = max(1, width)
    bucket = F.floor(F.col(value) / width_).cast("long")
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), *(F.col(k).alias(f"k_{k}") for k in keys), bucket.alias("bucket"))
    near = F.explode(F.array(*(bucket + d for d in (-1, 0, 1))))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), *(F.col(k).alias(f"k_{k}") for k in keys), near.alias("bucket"))
    joined = a.join(b, [*(f"k_{k}" for k in keys), "bucket"])
    return joined.filter(F.abs(F.col(f"l_{value}") - F.col(f"r_{value}")) <= width).drop("bucket", *(f"k_{k}" for k in keys))


def mutually_unique(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs in which each side has the other as its only partner. Partners are counted before the shuffle."""
    ones_left = pairs.groupBy(left).agg(F.count("*").alias("n")).filter("n = 1").select(F.col(left).alias("only_left"))
    ones_right = pairs.groupBy(right).agg(F.count("*").alias("n")).filter("n = 1").select(F.col(right).alias("only_right"))
    return pairs.join(ones_left, F.col(left) == F.col("only_left"), "left_semi").join(ones_right, F.col(right) == F.col("only_right"), "left_semi")


def taxes_agree(tolerance: int) -> Column:
    """All tax heads of a pair agree within the tolerance."""
    agree = F.lit(True)
    for head in ("igst", "cgst", "sgst"):
        agree = agree & (F.abs(F.col(f"l_{head}") - F.col(f"r_{head}")) <= tolerance)
    return agree


PIECE_KEYS = ["m", "n", "i", "piece"]


def name_pieces(left: DataFrame, right: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``name`` and ``other`` (names of one column each) under keys of which two names alike by ``least`` percent or more have one in common.

    Names within ``d`` edits share a piece: of ``d + 1`` even pieces of one, at least
    one stands whole in the other, shifted by ``d`` places at most.  ``d`` follows from
    both lengths, which are part of the key.
    ``least`` is above 50.  Blank and missing names meet nothing.
    """
    slack = 1000 - 10 * least + 5  # per mille of the longer length, as halves are rounded up
    other_length = lambda n: F.explode(F.sequence(F.ceil(F.lit(1000 - slack) * n / 1000).cast("int"), F.floor(F.lit(1000) * n / (1000 - slack)).cast("int")))
    edits = F.floor(F.lit(slack) * F.greatest("m", "n") / 1000).cast("int")
    pieces = F.explode(F.sequence(F.lit(0), F.col("edits")))
    start = F.floor(F.col("i") * F.col("n") / (F.col("edits") + 1)).cast("int")
    size = F.floor((F.col("i") + 1) * F.col("n") / (F.col("edits") + 1)).cast("int") - F.col("start")

    def cut(rows: DataFrame, name: str, own: str, its: str) -> DataFrame:
        text = F.lower(F.trim(rows.columns[0]))
        named = rows.select(F.col(rows.columns[0]).alias(name), text.alias("text"), F.length(text).alias(own)).filter(F.col(own) > 0).distinct()
        sized = named.withColumn(its, other_length(F.col(own))).withColumn("edits", edits)
        return sized.withColumn("i", pieces).withColumn("start", start).withColumn("size", size)

    indexed = cut(right, "other", "n", "m").select("other", "m", "n", "i", F.substring(F.col("text"), F.col("start") + 1, F.col("size")).alias("piece"))
    first, last = F.greatest(F.lit(0), F.col("start") - F.col("edits")), F.least(F.col("m") - F.col("size"), F.col("start") + F.col("edits"))
    places = cut(left, "name", "m", "n").withColumns({"first": first, "last": last}).filter("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    probes = places.select("name", "m", "n", "i", F.substring(F.col("text"), F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    return probes, indexed


TILE = 1024


def dense_lengths(probes: DataFrame, indexed: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``m, n``, and names of these lengths in ``left`` and ``right``, where names would meet by more pieces than there are pairs: names with a common stem. Lengths of ``right`` up to 64."""
    met = probes.groupBy(*PIECE_KEYS).agg(F.count("*").alias("p")).join(indexed.groupBy(*PIECE_KEYS).agg(F.count("*").alias("q")), PIECE_KEYS)
    met = met.filter("n <= 64").groupBy("m", "n").agg(F.sum(F.col("p").cast("double") * F.col("q")).alias("met"))
    sizes = [side.groupBy(length).agg(F.count("*").alias(f"of_{length}")) for side, length in ((left, "m"), (right, "n"))]
    return met.join(sizes[0], "m").join(sizes[1], "n").filter(F.col("met") > F.col("of_m").cast("double") * F.col("of_n")).drop("met")


def _alike(names: list[str], others: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``names`` (all of one length) and ``others`` (of one length, up to 64) of pairs that are alike, and their similarity: edit distances by bits, one column of the matrix a word."""
    m, n = len(names[0]), len(others[0])
    own, its = (np.array(texts, f"U{size}").view(np.uint32).reshape(len(texts), size) for texts, size in ((names, m), (others, n)))
    alphabet = np.unique(its)
    places = np.zeros((len(alphabet) + 1, len(others)), np.uint64)  # the last one for letters that none has
    for at in range(n):
        places[np.searchsorted(alphabet, its[:, at]), np.arange(len(others))] |= np.uint64(1 << at)
    codes = np.minimum(np.searchsorted(alphabet, own), len(alphabet) - 1)
    codes = np.where(alphabet[codes] == own, codes, len(alphabet))
    percent = np.floor((1 - np.arange(max(m, n) + 1) / max(m, n)) * 100 + 0.5).astype(np.int32)
    one, last = np.uint64(1), np.uint64(n - 1)
    found = []
    step = max(1, 16_384 // len(others))  # what stays in a core's cache
    for lo in range(0, len(names), step):
        part = codes[lo : lo + step]
        up, down = np.full((len(part), len(others)), ~np.uint64(0)), np.zeros((len(part), len(others)), np.uint64)
        score = np.full(up.shape, n, np.int64)
        for at in range(m):
            equal = places[part[:, at]]
            diagonal = equal | down
            across = (((equal & up) + up) ^ up) | equal
            rises, falls = down | ~(across | up), up & across
            score += ((rises >> last) & one).view(np.int64)
            score -= ((falls >> last) & one).view(np.int64)
            rises, falls = (rises << one) | one, falls << one
            up, down = falls | ~(diagonal | rises), rises & diagonal
        similarity = percent[score]
        name, other = np.nonzero(similarity >= least)
        found.append((name + lo, other, similarity[name, other]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _in_tiles(left: DataFrame, right: DataFrame, dense: DataFrame, least: int) -> DataFrame:
    """``name, other, similarity`` of all pairs alike among names of such lengths: each task compares a tile of one side with a tile of the other."""
    blocks = {length: F.ceil(F.col(f"of_{length}") / TILE).cast("int") for length in "mn"}
    all_of = lambda length: F.explode(F.sequence(F.lit(0), blocks[length] - 1))
    block_of = lambda length: F.pmod(F.xxhash64("text"), blocks[length]).cast("int")
    a = left.join(F.broadcast(dense), "m").select("m", "n", "name", "text", block_of("m").alias("at"), all_of("n").alias("beside"))
    b = right.join(F.broadcast(dense), "n").select("m", "n", "other", "text", block_of("n").alias("beside"), all_of("m").alias("at"))
    tiles = dense.agg(F.coalesce(F.sum(blocks["m"] * blocks["n"]), F.lit(1))).first()[0]
    keys, parts = ["m", "n", "at", "beside"], min(tiles, 10_000)  # tiles are small to ship and long to compare, so their sizes must not join them into few tasks

    def compared(one: pa.Table, two: pa.Table) -> pa.Table:
        places = (np.array([], np.int64),) * 3
        if len(one) and len(two):
            places = _alike(one["text"].to_pylist(), two["text"].to_pylist(), least)
        return pa.table({"name": one["name"].take(places[0]), "other": two["other"].take(places[1]), "similarity": pa.array(places[2], pa.int32())})

    sides = [side.repartition(parts, *keys).groupBy(*keys) for side in (a, b)]
    return sides[0].cogroup(sides[1]).applyInArrow(compared, "name string, other string, similarity int")


def similar_names(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """``name, other, similarity`` of names (one column each) that are alike by ``least`` percent or more: all pairs with a common piece, measured.

    Where names of two lengths have most pieces in common, they are compared in tiles instead: each pair once, with nothing to make distinct.
    """
    def measured(rows: DataFrame, name: str, length: str) -> DataFrame:
        text = F.lower(F.trim(rows.columns[0]))
        return rows.select(F.col(rows.columns[0]).alias(name), text.alias("text"), F.length(text).alias(length)).filter(F.col(length) > 0).distinct()

    sides = staged(measured(left, "name", "m"), "names"), staged(measured(right, "other", "n"), "names")
    probes, indexed = name_pieces(sides[0].select("name"), sides[1].select("other"), least)
    dense = staged(dense_lengths(probes, indexed, *sides), "dense-lengths")
    seldom = probes.join(F.broadcast(dense.select("m", "n")), ["m", "n"], "left_anti")
    pairs = seldom.join(indexed, PIECE_KEYS).select("name", "other").distinct()
    pairs = pairs.withColumn("similarity", similarity_percent(F.col("name"), F.col("other")))
    return pairs.unionByName(_in_tiles(*sides, dense, least)).filter(F.col("similarity") >= least)


def one_letter_apart(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """Names of ``left`` (one column each) that are alike by ``least`` to 99 percent to a name in ``right`` of their length, one letter aside. Work and memory follow the letters, not the pairs."""
    name = left.columns[0]
    percent = F.floor((1 - 1 / F.col("n")) * 100 + 0.5)

    def without_a_letter(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("text", F.lower(F.trim(rows.columns[0])))
        rows = rows.withColumn("n", F.length("text")).filter((F.col("n") > 1) & percent.between(least, 99)).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n"))))
        return rows.withColumn("others", F.concat(F.substring(F.col("text"), F.lit(1), F.col("at") - 1), F.substring(F.col("text"), F.col("at") + 1, F.col("n"))))

    met = without_a_letter(right).groupBy("at", "others").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return without_a_letter(left).join(met, ["at", "others"]).filter("least <> text or most <> text").select(name).distinct()
