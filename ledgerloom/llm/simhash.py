"""Operator 1: SimHash near-duplicates by tiled exact comparison.

Fingerprints: A-Z is lower-cased in the whole text; words are what stands
between spaces and control white space; shingles are three words, repeats
included, joined by a space (all words if there are fewer).  A bit is set if it
is set in more than half of the shingles' XXH64 values (seed 42).  A text
without words has fingerprint zero.

Links: equal fingerprints are one node.  The distinct fingerprints are dealt to
tiles by the population counts of their two, four or eight equal parts, at most
``tile_rows`` or so to a tile (a crowded class is split by hash).  If two
fingerprints differ in ``radius`` bits or fewer, then the population counts of
their parts differ by ``radius`` or less in sum, so only pairs of tiles within
that distance meet; all others are skipped.  A pair of tiles is compared
exactly with numpy (exclusive-or and bit counts), a block of rows at a time.
It gives a spanning star for each group of linked fingerprints, never all their
pairs, and loses no connection.  Components of those links follow.

The number of parts grows with the number of distinct fingerprints (it sets
only which pairs are skipped, not the result): with 2, 4 and 8 parts about
1/8, 1/60 and 1/2700 of all pairs of random fingerprints are compared.

Cases: a null or empty text has fingerprint zero, linked like any other; rows of
one doc_id count as one document; a row with a null doc_id gets its fingerprint
and a null component, and links nothing; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.components import components
from ledgerloom.llm.workspace import written

SEED = 42
SHINGLE = 3
RADIUS = 2
TILE_ROWS = 8192
#: Parts by which distinct fingerprints are classed, and the most of them for which that is fine enough.
PARTS = ((2, 2_000_000), (4, 1_000_000_000), (8, None))


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65_536):
        block = hashes[start : start + 65_536]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long, for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(text.as_py() or b"") for text in batch.column(1).cast(pa.binary())), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["doc_id", "bits"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(each, "doc_id long, bits long")


def _class(bits: Column, parts: int) -> Column:
    """Population counts of the parts, as digits of one number."""
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned(bits, width * i).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))) for i in range(parts)]
    code = counts[0].cast("long")
    for count in counts[1:]:
        code = code * (width + 1) + count
    return code


def _offsets(parts: int, radius: int) -> list[int]:
    """Differences between the classes of fingerprints that may be within the radius."""
    base = 64 // parts + 1
    steps: set[tuple[int, ...]] = {(0,) * parts}
    for _ in range(radius):
        steps |= {s[:i] + (s[i] + d,) + s[i + 1 :] for s in steps for i in range(parts) for d in (-1, 1)}
    codes = set()
    for step in steps:
        code = 0
        for d in step:
            code = code * base + d
        codes.add(code)
    return sorted(codes)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        further = parent[parent]
        if (further == parent).all():
            return parent
        parent = further


def _linked(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """The root of each member of left (and right, behind it): equal roots are connected within this pair of tiles."""
    parent = np.arange(len(left) + (0 if same else len(right)))
    shift = 0 if same else len(left)
    step = max(1, 2_000_000 // max(1, len(right)))
    for start in range(0, len(left), step):
        close = np.bitwise_count(left[start : start + step, None] ^ right[None, :]) <= radius
        rows, columns = np.nonzero(close)
        a, b = parent[rows + start], parent[columns + shift]
        differ = a != b
        for x, y in np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        parent = _roots(parent)
    return parent


def _compare(radius: int):
    def pair(table: pa.Table) -> pa.Table:
        sides = {side: (bits, nodes) for side, bits, nodes in zip(table["side"].to_pylist(), table["bits"], table["nodes"], strict=True)}
        a, b = [], []
        if len(sides) == 2 or 2 in sides:
            tiles = [sides[2]] if 2 in sides else [sides[0], sides[1]]
            values = [np.asarray(bits.values).view("<u8") for bits, _ in tiles]
            nodes = np.concatenate([np.asarray(nodes.values) for _, nodes in tiles])
            parent = _linked(values[0], values[-1], len(tiles) == 1, radius)
            linked = np.nonzero(parent != np.arange(len(parent)))[0]
            a, b = nodes[linked], nodes[parent[linked]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pair


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, parts: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that connect all fingerprints within the radius. ``nodes``: distinct ``bits`` and their ``node``."""
    if parts is None:
        n = nodes.count()
        parts = next(p for p, most in PARTS if most is None or n <= most)
    nodes = nodes.withColumn("class", _class(F.col("bits"), parts))
    chunks = nodes.groupBy("class").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("chunks"))
    chunks = written(chunks, "simhash-classes")
    near = chunks.withColumn("other", F.explode(F.array(*map(F.lit, _offsets(parts, radius)))))
    near = near.select("class", "chunks", (F.col("class") + F.col("other")).alias("other"))
    near = near.join(chunks.select(F.col("class").alias("other"), F.col("chunks").alias("other_chunks")), "other")
    near = near.groupBy("class", "chunks").agg(F.collect_list(F.struct("other", "other_chunks")).alias("near"))

    dealt = nodes.join(chunks, "class").withColumn("chunk", F.pmod(F.xxhash64("bits"), F.col("chunks").cast("long")).cast("int"))
    tiles = dealt.groupBy("class", "chunk").agg(F.collect_list(F.struct("bits", "node")).alias("rows"))
    tiles = tiles.select("class", "chunk", F.col("rows.bits").alias("bits"), F.col("rows.node").alias("nodes"))
    tile = F.struct("class", "chunk")
    meets = tiles.join(near, "class").withColumn("near", F.explode("near")).withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("near.other_chunks") - 1)))
    other = F.struct(F.col("near.other").alias("class"), F.col("other_chunk").alias("chunk"))
    meets = meets.select(F.least(tile, other).alias("first"), F.greatest(tile, other).alias("second"), F.when(tile == other, 2).when(tile < other, 0).otherwise(1).alias("side"), "bits", "nodes")
    return meets.groupBy("first", "second").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, parts: int | None = None) -> DataFrame:
    """``doc_id``, ``bits`` and ``component_id`` (the smallest doc_id that links reach) of every row."""
    marked = written(fingerprints(docs), "simhash")
    nodes = written(marked.filter("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # A node is the smallest doc_id of its fingerprint. Rows of one doc_id with several texts make further links.
    repeats = marked.filter("doc_id is not null").groupBy("doc_id").agg(F.min("bits").alias("least"), F.max("bits").alias("most")).filter("least <> most")
    texts = marked.join(repeats.select("doc_id"), "doc_id", "left_semi").join(nodes, "bits").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links(nodes, radius, tile_rows, parts).unionByName(texts))
    classes = nodes.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    named = marked.join(written(classes, "simhash-classes"), "bits", "left")
    return named.select("doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that of its smallest doc_id. Rows with a null doc_id stay."""
    found = near_duplicates(docs, **options)
    kept = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = written(kept, "simhash-kept")
    ids = docs["doc_id"].cast("long")
    stay = docs.withColumn("__simhash_id", ids).join(kept.select(F.col("doc_id").alias("__simhash_id")), "__simhash_id", "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        stay = stay.dropDuplicates(["__simhash_id"])
    return stay.select(*docs.columns).unionByName(docs.filter(ids.isNull()))
