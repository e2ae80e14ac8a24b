"""Operator 6: document fingerprints by locally consistent parsing.

Code points get 64-bit names.  A level first joins runs of equal names to one
symbol.  Deterministic coin tossing then labels each symbol by the lowest bit
in which it differs from its left neighbour, and that bit's value; doing so on
the labels again, four times in all, leaves labels 0 to 5 of which no two
neighbours are equal.  A symbol whose label is greater than both neighbours'
starts a phrase, and a phrase is named by its symbols.  Phrases are the symbols
of the next level (about 3 code points at level 1, 10 at level 2).  Whether a
phrase starts at a symbol depends on a handful of its neighbours only, so equal
substrings get the same phrases inside, wherever they stand.

A fingerprint holds the least ``SKETCH`` 32-bit hashes of a text's distinct
phrases at levels 1 and 2, as hexadecimal numbers, with a dash between the
levels.  The likeness of two fingerprints is the share that their phrases have
in common (Jaccard), estimated from the least hashes of the union of each level;
a level weighs as much as it has such hashes, so level 2, of which more are
kept, tells for most, and level 1 for texts of a few phrases.  Texts with the same phrases, so equal texts at least, have likeness 1.

``with_neighbours`` brings each document together with the next one: rows go to
ranges of ids of about equal size, the first row of every range goes to the
range before it too, and a range is read in order as a stream.  So one shuffle
moves each text once, whatever the gaps between ids.

Cases: a null text is empty; a null doc_id comes before all others; rows with
equal ids follow each other in the order of their texts; the last document's
next one is the first, and an only document is its own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workspace import shuffle_width

SKETCH = (16, 80)  #: Hashes kept at levels 1 and 2
BLOCK_POINTS = 1_000_000
_LEAST = -(2**63)

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 by deterministic coin tossing; neighbours within a text differ."""
    at = np.nonzero(starts)[0]
    label = names
    for _ in range(4):
        one = label.dtype.type(1)
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[at] = label[at] ^ one  # a first symbol is set against one that differs in the lowest bit
        differ = label ^ before
        lowest = np.bitwise_count(((differ & (~differ + one)) - one).view(differ.dtype))
        value = ((label >> lowest.astype(label.dtype)) & one).astype(np.uint8)
        label = lowest * np.uint8(2) + value
    return label


def _phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names of phrases, and whether each starts a text."""
    n = len(names)
    run = starts.copy()
    run[1:] |= names[1:] != names[:-1]
    at = np.nonzero(run)[0]
    if len(at) < n:
        lengths = np.diff(at, append=n)
        joined = names[at].copy()
        long = lengths > 1
        joined[long] = _mix(joined[long] + _mix(lengths[long].astype(np.uint64)))
        names, starts = joined, starts[at]
        n = len(names)
    label = _labels(names, starts)
    heads = starts.copy()
    rises = np.zeros(n, bool)
    rises[1:] = label[1:] > label[:-1]
    falls = np.ones(n, bool)
    falls[:-1] = (label[:-1] > label[1:]) | starts[1:]
    heads |= rises & falls
    at = np.nonzero(heads)[0]
    within = (np.arange(n) - np.repeat(at, np.diff(at, append=n))).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(names + within * np.uint64(0x9E3779B97F4A7C15)), at)), starts[at]


def sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each text the least hashes of its distinct phrases, level by level, ascending."""
    filled = [text for text in texts if text]
    none = tuple(np.zeros(0, np.uint32) for _ in SKETCH)
    if not filled:
        return [none] * len(texts)
    names = _mix(np.frombuffer("".join(filled).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
    starts = np.zeros(len(names), bool)
    starts[np.cumsum([0, *(len(text) for text in filled[:-1])])] = True
    levels = []
    for size in SKETCH:
        names, starts = _phrases(names, starts)
        hashes = (names >> np.uint64(32)).astype(np.uint32)
        cuts = [*np.nonzero(starts)[0], len(names)]
        levels.append([np.unique(hashes[lo:hi])[:size] for lo, hi in zip(cuts, cuts[1:], strict=False)])
    found = iter(zip(*levels, strict=True))
    return [next(found) if text else none for text in texts]


def as_string(sketch: tuple[np.ndarray, ...]) -> str:
    return "-".join(level.astype(">u4").tobytes().hex() for level in sketch)


def from_string(fingerprint: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes.fromhex(level), ">u4").astype(np.uint32) for level in fingerprint.split("-"))


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Estimated share of common phrases, 0 to 1."""
    shared = weight = 0
    for x, y, size in zip(a, b, SKETCH, strict=True):
        both = np.concatenate([x, y])
        both.sort()
        common = np.zeros(len(both), bool)
        common[1:] = both[1:] == both[:-1]
        distinct = np.cumsum(~common)
        shared += int(common[distinct <= size].sum())
        weight += min(size, int(distinct[-1])) if len(both) else 0
    return shared / weight if weight else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows ``(range, extra, key, doc_id, text)``, each range in one partition and in order.

    ``extra`` is 1 for rows that stand first in the next range.
    """
    ranges = ranges or shuffle_width(docs.sparkSession)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    ids = keyed.select("key")
    cuts = ids.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], F.lit(max(10_000, 20 * ranges)))).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    least = {row["range"]: row["least"] for row in ids.groupBy(range_of("key").alias("range")).agg(F.min("key").alias("least")).collect()}
    present = sorted(least)
    earlier = {least[r]: present[i - 1] for i, r in enumerate(present)}

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), side="right")
        return pd.Series([[2 * r] if k not in earlier else [2 * r, 2 * earlier[k] + 1] for k, r in zip(key.tolist(), own.tolist(), strict=True)])

    dealt = keyed.withColumn("place", F.explode(places("key")))
    dealt = dealt.select(F.expr("place div 2").cast("int").alias("range"), (F.col("place") % 2).alias("extra"), "key", "doc_id", "text")
    return dealt.repartitionById(max(1, len(bounds) + 1), F.col("range")).sortWithinPartitions("range", "extra", "key", "text")


def fingerprinted(docs: DataFrame, ranges: int | None = None, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are to each other and to the next document's."""

    def rows(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(text, following) for _, text, following in pairs]
        # A text is the next one of the row before it, so most are parsed once.
        texts = list(dict.fromkeys(t for _, text, following in pairs for t in (text, following)))
        sketch = dict(zip(texts, sketches(texts), strict=True))
        out = []
        for (doc_id, text, following), new, of_new in zip(pairs, changed, sketches(changed), strict=True):
            own = sketch[text]
            out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_string(own), as_string(of_new), likeness(own, of_new), likeness(own, sketch[following])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [field.split()[0] for field in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        points = 0
        held = None  # (range, doc_id, text) that waits for the one after it
        for batch in batches:
            for where, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[0] == where:
                    pairs.append((held[1], held[2], text))
                    points += 2 * len(held[2]) + len(text)
                held = None if extra else (where, doc_id, text)
                if points >= block_points:
                    yield rows(pairs)
                    pairs, points = [], 0
        if pairs:
            yield rows(pairs)

    return with_neighbours(docs, ranges).select("range", "extra", "doc_id", "text").mapInArrow(run, SCHEMA)
