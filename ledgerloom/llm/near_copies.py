"""Near copies by exact similarity of word shingles: the pipeline's near-dedup stage.

Two documents are linked if the sets of their five-word shingles (as ``simhash``
words them) have a Jaccard similarity of 80 percent or more.  No link is lost:

- equal sets are one node, named by a hash of the set;
- linked sets share at least 80 percent of the larger one's shingles, so if all
  shingles stand in one order, the first fifth (and one more) of each have one in
  common.  Rare shingles stand first, and those of one document alone link
  nothing, so most documents have none left to look up;
- sets that share such a shingle are connected; linked sets lie in one connected
  set.  Small ones are compared by the bucket, large ones by pairs of tiles, by
  counts of shared shingles, and each group gives a spanning forest of its links.

How often a shingle stands in the table is found by blocks and buckets: a task
gives the shingles of a block of documents (48 bits of each, and which document
of the block) to the shingles' buckets; a bucket tells blocks which of them stand
elsewhere too, and how often.  So texts are not shuffled to be compared.  A
shingle that several documents of a block have is given once, with their number;
so however common it is, its bucket holds it once for each block.

Components of the links follow.  Work within a connected set grows with its
square; candidates are never capped.

Cases: null and empty texts are equal; texts below five words are one shingle;
rows of one doc_id count as one document; rows with a null doc_id stay; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.simhash import SEED
from ledgerloom.llm.workspace import shuffle_width, written
from ledgerloom.operators.components import components

SHINGLE = 5
PERCENT = 80
TILE_ROWS = 512
BLOCK_SHINGLES = 500_000
BUCKET_BYTES = 64 << 20  #: Bytes of text for one bucket of shingles


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, as sorted hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), "<u8"))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [_node(shingles(text.as_py() or b"")) for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64())], ["doc_id", "node"])


def _packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits, six bytes each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


#: A block's shingles in a bucket, with their document's place in the block, or how often they stand in it; or its documents' nodes and sizes, with the shingles that several of them have.
POSTINGS = "bucket long, block long, tokens binary, owners binary, often binary, nodes binary, sizes binary"
_NAMES = [field.split()[0] for field in POSTINGS.split(", ")]
_KINDS = (pa.int64(), pa.int64(), *[pa.binary()] * 5)


def _rows(rows: list[tuple], names: list[str] = _NAMES) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(_KINDS), _KINDS, strict=True)], names)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = [*np.nonzero(np.diff(bucket, prepend=-1))[0].tolist(), len(bucket)]
    return ((int(bucket[lo]), slice(lo, hi)) for lo, hi in itertools.pairwise(cuts))


def _ids(tokens: np.ndarray, bucket: np.ndarray | np.uint64) -> np.ndarray:
    """What names a shingle across buckets: 48 bits of its hash, and 16 of its bucket's number."""
    return (tokens | bucket % np.uint64(65_536) << np.uint64(48)).astype("<u8")


def _posted(buckets: int, block_shingles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n_held, block = 0, TaskContext.get().partitionId() << 32

        def flushed() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in held.values()], np.int64)
            tokens = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            owners = np.repeat(np.arange(len(held)), sizes)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((tokens, bucket))
            tokens, owners, bucket = tokens[order], owners[order].astype("<u4"), bucket[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            counts = np.diff(np.nonzero(first)[0], append=len(tokens))
            once = counts[np.cumsum(first) - 1] == 1 if len(tokens) else first
            rows = [(b, block, _packed(tokens[once][part]), owners[once][part].tobytes(), None, None, None) for b, part in _by_bucket(bucket[once])]
            again = first & ~once
            counts = counts[counts > 1].astype("<u4")
            rows += [(b, block, _packed(tokens[again][part]), None, counts[part].tobytes(), None, None) for b, part in _by_bucket(bucket[again])]
            own = _ids(tokens[~once] >> np.uint64(16), bucket[~once].astype(np.uint64))
            rows.append((block % buckets, block, own.tobytes(), owners[~once].tobytes(), None, np.array(list(held), "<i8").tobytes(), sizes.astype("<i8").tobytes()))
            yield from _rows(rows).to_batches()

        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(text.as_py() or b"")
                node = _node(found)
                if node not in held:
                    held[node] = found
                    n_held += len(found)
                if n_held >= block_shingles:
                    yield from flushed()
                    held, n_held, block = {}, 0, block + 1
        if held:
            yield from flushed()

    return run


def _counted(table: pa.Table) -> pa.Table:
    """For a bucket: each block's shingles that stand elsewhere too, and how often they stand (up to 65,535; it only sets their order)."""
    rows = table.to_pylist()
    out = [tuple(row[name] for name in _NAMES) for row in rows if row["nodes"] is not None]
    rows = [row for row in rows if row["nodes"] is None]
    if rows:
        tokens = [_unpacked(row["tokens"]) for row in rows]
        weights = [np.ones(len(part), np.uint32) if row["often"] is None else np.frombuffer(row["often"], "<u4") for row, part in zip(rows, tokens, strict=True)]
        _, which = np.unique(np.concatenate(tokens), return_inverse=True)
        often = np.minimum(np.bincount(which, np.concatenate(weights))[which], 65_535)
        end = 0
        for row, part in zip(rows, tokens, strict=True):
            start, end = end, end + len(part)
            shared = often[start:end] > 1
            if shared.any():
                owners = row["owners"] and np.frombuffer(row["owners"], "<u4")[shared].tobytes()
                out.append((row["bucket"], row["block"], _ids(part[shared], np.uint64(row["bucket"])).tobytes(), owners, often[start:end][shared].astype("<u2").tobytes(), None, None))
    return _rows(out)


HELD = "node long, n long, tokens binary, prefix array<long>"


def _prefixed(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """For a block: its documents that can have a link, with all shingles that stand elsewhere, rare ones first, and those to look up."""
        rows = table.to_pylist()
        of = next(row for row in rows if row["nodes"] is not None)
        nodes, sizes = np.frombuffer(of["nodes"], "<i8"), np.frombuffer(of["sizes"], "<i8")
        kinds = {"tokens": "<u8", "owners": "<u4", "often": "<u2"}

        def joined(name: str, several: bool) -> np.ndarray:
            return np.frombuffer(b"".join(row[name] for row in rows if row["nodes"] is None and (row["owners"] is None) == several), kinds[name])

        # Of shingles that several documents of the block have, the counts come back, and the documents are here.
        order = np.argsort(joined("tokens", True))
        own = np.frombuffer(of["tokens"], "<u8")
        own_often = joined("often", True)[order][np.searchsorted(joined("tokens", True)[order], own)] if len(own) else np.zeros(0, "<u2")
        tokens = np.concatenate([joined("tokens", False), own])
        owners = np.concatenate([joined("owners", False), np.frombuffer(of["owners"], "<u4")])
        often = np.concatenate([joined("often", False), own_often])
        order = np.lexsort((tokens, often, owners))
        tokens, owners = tokens[order], owners[order].astype(np.int64)
        bounds = np.searchsorted(owners, np.arange(len(nodes) + 1))
        held = np.diff(bounds)
        # The first n - ceil(n * percent / 100) + 1 shingles, less those that no other document has.
        first = sizes + 1 - (sizes * percent + 99) // 100 - (sizes - held)
        picked = np.nonzero((first > 0) & (held > 0))[0].tolist()
        signed = tokens.view(np.int64)
        return pa.table({
            "node": pa.array(nodes[picked], pa.int64()),
            "n": pa.array(sizes[picked], pa.int64()),
            "tokens": pa.array([tokens[bounds[i] : bounds[i + 1]].tobytes() for i in picked], pa.binary()),
            "prefix": pa.array([signed[bounds[i] : bounds[i] + first[i]] for i in picked], pa.list_(pa.int64())),
        })

    return run


def _linked(percent: int):
    def group(table: pa.Table) -> pa.Table:
        nodes = np.asarray(table["node"])
        sets = [np.frombuffer(blob.as_py(), "<u8") for blob in table["tokens"]]
        sizes = np.asarray(table["n"])
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shared = often[token] > 1
        token, owner = token[shared], owner[shared]
        order = np.argsort(token, kind="stable")
        members = owner[order]
        begin, end = np.searchsorted(token[order], token, "left"), np.searchsorted(token[order], token, "right")
        bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
        parent = np.arange(len(sets))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        for x in range(len(sets)):
            if bounds[x] == bounds[x + 1]:
                continue
            met = np.concatenate([members[begin[i] : end[i]] for i in range(bounds[x], bounds[x + 1])])
            both = np.bincount(met[met < x], minlength=1)
            both = np.pad(both, (0, max(0, x - len(both))))[:x]
            for y in np.nonzero(100 * both >= percent * (sizes[x] + sizes[:x] - both))[0]:
                if (i := root(x)) != (j := root(y)):
                    parent[max(i, j)] = min(i, j)
                    a.append(nodes[x])
                    b.append(nodes[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return group


def links(docs: DataFrame, percent: int = PERCENT, tile_rows: int = TILE_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that connect all sets of the texts of ``docs`` alike by ``percent``."""
    spark = docs.sparkSession
    n_bytes = docs.select(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
    buckets = max(shuffle_width(spark), math.ceil(n_bytes / BUCKET_BYTES))
    posted = docs.select("doc_id", "text").mapInArrow(_posted(buckets, block_shingles), POSTINGS)
    counted = posted.groupBy("bucket").applyInArrow(_counted, POSTINGS)
    held = written(counted.groupBy("block").applyInArrow(_prefixed(percent), HELD), "near-held")
    prefixes = held.select("node", F.explode("prefix").alias("token"))
    least = prefixes.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    sets = written(components(prefixes.join(least, "token").select("node", "least").distinct()), "near-sets")

    tiles = sets.groupBy("component").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    # Copies in several blocks are one set.
    dealt = held.select("node", "n", "tokens").dropDuplicates(["node"]).join(sets.join(tiles, "component"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int")
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("own"))))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    bucket = F.pmod(F.xxhash64("component"), F.lit(16 * buckets))
    key = F.when(F.col("tiles") == 1, F.struct(bucket.alias("of"), F.lit(-1).alias("x"), F.lit(-1).alias("y")))
    key = key.otherwise(F.struct(F.col("component").alias("of"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    meets = dealt.select(key.alias("key"), "node", "n", "tokens").select("key.of", "key.x", "key.y", "node", "n", "tokens")
    return meets.groupBy("of", "x", "y").applyInArrow(_linked(percent), "a long, b long")


def near_copies(docs: DataFrame, also: DataFrame | None = None, **options) -> DataFrame:
    """``doc_id`` and ``component_id`` (the smallest doc_id that links reach) of every row with a doc_id. ``also``: more links, pairs of doc_ids."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).filter("doc_id is not null")
    marked = written(known.mapInArrow(_marks, "doc_id long, node long"), "near-marks")
    by_doc = written(marked.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")), "near-documents")
    several = marked.join(by_doc.filter("least <> most"), "doc_id").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = links(known, **options).unionByName(several)
    if also is not None:
        for end, name in zip("ab", also.columns, strict=True):
            also = also.join(by_doc.select(F.col("doc_id").alias(name), F.col("least").alias(end)), name)
        found = found.unionByName(also.select("a", "b"))
    named = marked.join(components(found), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    named = written(named, "near-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that of its smallest doc_id. Rows with a null doc_id stay."""
    kept = near_copies(docs, **options).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = written(kept, "near-kept")
    ids = docs["doc_id"].cast("long")
    stay = docs.withColumn("__near_id", ids).join(kept.select(F.col("doc_id").alias("__near_id")).hint("merge"), "__near_id", "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        stay = stay.dropDuplicates(["__near_id"])
    return stay.select(*docs.columns).unionByName(docs.filter(ids.isNull()))
