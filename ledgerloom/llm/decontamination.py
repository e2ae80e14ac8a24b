"""Operator 13: benchmark decontamination by suffix arrays of the training texts.

Documents are taken in shards of about ``shard_words`` words, as they come in a
partition.  A shard's words become numbers (0: a word that no benchmark item
has), and the places of its words are sorted by the suffixes that start there.
Every test suffix is then searched in all shards at once, word by word: the places
whose suffixes start with the words so far are one interval of the array, and two
binary searches narrow it by the next word.  Where the interval would become
empty, the longest verbatim match of the test suffix in the shard is found, and
the interval holds all its locations.

A window is ``window`` words of an item (an item of fewer words is one window).
The interval of a test suffix at that depth holds all occurrences of the window;
words within one are hit, and a document with a hit word is contaminated.

Sorting: a first key packs as many word numbers as 63 bits hold; only places that
it leaves tied are sorted further, by the ranks of what follows, in doubling
steps, until the longest test suffix could be told from others.

Scale: one pass over the input partitions, without a shuffle, and what a task
holds is one shard.  The benchmark is sent to the tasks in slices of about
``slice_bytes``; items of very many words go in overlapping pieces, so a slice
is bounded.  Usually there is one slice.  With more, documents pass through them
one after another, each pass written before the next.

Cases: null texts have no words, and items without words no windows; very long
documents are a shard of their own; of benchmark rows with equal item_id each adds
its windows to the one item; a null item_id counts as an item named by the empty
string; repeated documents and rows with equal ids are judged one by one; an empty
table of documents gives no rows, an empty benchmark no hits; other columns,
whatever their names, are passed on by ``decontaminated`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workspace import written

WINDOW = 10
SHARD_WORDS = 1 << 21
SLICE_BYTES = 32 << 20
PIECE_WORDS = 4096
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Lower-cases A-Z and makes a space of every byte that is not part of a word.
_PLAIN = bytes(b if b >= 0x80 or chr(b) in string.digits + string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Probe:
    """A slice of the benchmark. Words are numbered from 1; ``words`` holds pieces of items one after the other, ``left`` the words from each on to its piece's end."""

    numbers: dict[bytes, int]
    words: np.ndarray
    left: np.ndarray
    item: np.ndarray
    place: np.ndarray  #: Of each word within its item
    items: list[str]
    window: int

    @classmethod
    def of(cls, pieces: list[tuple[str, int, list[str]]], window: int) -> Probe:
        numbers: dict[bytes, int] = {}
        items = sorted({item for item, _, _ in pieces})
        index = {item: n for n, item in enumerate(items)}
        words, left, item, place = [], [], [], []
        for name, start, piece in pieces:
            words += [numbers.setdefault(w.encode(), len(numbers) + 1) for w in piece]
            left += range(len(piece), 0, -1)
            item += [index[name]] * len(piece)
            place += range(start, start + len(piece))
        return cls(numbers, *(np.array(x, np.int64) for x in (words, left, item, place)), items, window)

    def windows(self) -> np.ndarray:
        """Where windows start: with enough words to the end, or at the start of an item of fewer."""
        short = np.zeros(len(self.left), bool)
        if len(short):
            heads = np.flatnonzero(np.append(True, self.left[:-1] == 1))
            short[heads] = (self.left[heads] < self.window) & (self.place[heads] == 0)
        return np.flatnonzero((self.left >= self.window) | short)


def suffix_array(ids: np.ndarray, reach: int) -> np.ndarray:
    """Places of numbered words, sorted by the first ``reach`` words of the suffixes that start there. ``ids`` ends with a 0.

    A 0 counts as less than any word; the order of suffixes beyond one does not matter, as no test suffix has it.
    """
    n = len(ids)
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    bits = int(ids.max()).bit_length()
    depth = max(1, min(63 // bits, reach))
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    key = np.zeros(len(at), np.int64)
    for i in range(depth):
        key = key << bits | padded[at + i]
    order = np.argsort(key, kind="stable")
    places, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    rank = -1 - np.arange(n)  # places of no word tie with none
    counted = np.arange(len(at))
    group = np.maximum.accumulate(np.where(new, counted, 0))
    rank[places] = group
    while depth < reach:
        tied = ~new
        tied[:-1] |= ~new[1:]
        i = np.flatnonzero(tied)
        if not len(i):
            break
        after = rank[np.minimum(places[i] + depth, n - 1)]
        order = np.lexsort((after, group[i]))
        places[i], after = places[i[order]], after[order]
        new[i[1:]] |= after[1:] != after[:-1]
        group = np.maximum.accumulate(np.where(new, counted, 0))
        rank[places[i]] = group[i]
        depth *= 2
    return places


def _bound(ids: np.ndarray, places: np.ndarray, depth: int, word: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """Binary search in each interval: the first place whose word at ``depth`` is not below ``word`` (or, with ``after``, above it)."""
    low, high = low.copy(), high.copy()
    still = np.flatnonzero(low < high)
    while len(still):
        middle = (low[still] + high[still]) >> 1
        found = ids[places[middle] + depth]
        below = found <= word[still] if after else found < word[still]
        low[still[below]] = middle[below] + 1
        high[still[~below]] = middle[~below]
        still = still[low[still] < high[still]]
    return low


def search(ids: np.ndarray, places: np.ndarray, words: np.ndarray, starts: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the test suffix at each of ``starts``, its longest match of at most ``limit`` words: its length and the interval of its places."""
    low, high, depth = np.zeros(len(starts), np.int64), np.full(len(starts), len(places), np.int64), np.zeros(len(starts), np.int64)
    going = np.arange(len(starts))
    while len(going := going[limit[going] > depth[going]]):
        d = int(depth[going[0]])
        word = words[starts[going] + d]
        first = _bound(ids, places, d, word, low[going], high[going], False)
        last = _bound(ids, places, d, word, first, high[going], True)
        more = first < last
        going = going[more]
        low[going], high[going], depth[going] = first[more], last[more], d + 1
    return depth, low, high


@dataclass
class Shard:
    """Documents of a shard: their words, each document followed by a 0."""

    ids: np.ndarray
    starts: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], reach: int) -> Shard:
        end = np.zeros(1, np.int32)
        ids = np.concatenate([part for row in rows for part in (row, end)])
        lengths = np.array([len(row) + 1 for row in rows])
        return cls(ids, np.cumsum(lengths) - lengths, suffix_array(ids, reach))

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def hits(self, probe: Probe) -> tuple[list[np.ndarray], list[list[str]]]:
        """For each document the runs of hit words, as begin and end, and its items."""
        starts = probe.windows()
        limit = np.minimum(probe.left[starts], probe.window)
        depth, low, high = search(self.ids, self.places, probe.words, starts, limit)
        found = np.flatnonzero(depth == limit) if len(starts) else starts
        # Windows of equal words have one interval, and intervals of one length do not overlap.
        bounds, which = np.unique(np.stack([limit[found], low[found], high[found]], axis=1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        spread = np.repeat(np.arange(len(bounds)), bounds[:, 2] - bounds[:, 1])
        inside = np.arange(len(spread)) - np.repeat(np.cumsum(bounds[:, 2] - bounds[:, 1]) - (bounds[:, 2] - bounds[:, 1]), bounds[:, 2] - bounds[:, 1])
        at = self.places[bounds[spread, 1] + inside]
        change = np.bincount(at, minlength=len(self.ids) + 1) - np.bincount(at + bounds[spread, 0], minlength=len(self.ids) + 1)
        hit = np.cumsum(change) > 0
        edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
        runs = edges.reshape(-1, 2)
        by_document = np.searchsorted(runs[:, 0], np.append(self.starts, len(self.ids)))
        spans = [runs[a:b] - start for a, b, start in zip(by_document[:-1], by_document[1:], self.starts, strict=True)]

        pairs = np.unique(np.stack([self.documents(at), spread], axis=1), axis=0)
        of_window: list[set[str]] = [set() for _ in bounds]
        for window, item in np.unique(np.stack([which, probe.item[starts[found]]], axis=1), axis=0).tolist():
            of_window[window].add(probe.items[item])
        items: list[set[str]] = [set() for _ in self.starts]
        for document, window in pairs.tolist():
            items[document] |= of_window[window]
        return spans, [sorted(x) for x in items]


def _binary(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())


def _shards(batches: Iterator[pa.RecordBatch], at: int, probe: Probe, shard_words: int, reach: int) -> Iterator[tuple[list[pa.RecordBatch], Shard]]:
    """Rows in shards, with the columns that they came in."""
    pieces: list[pa.RecordBatch] = []
    rows: list[np.ndarray] = []
    size, number = 0, probe.numbers.get
    for batch in batches:
        begin = 0
        for i, text in enumerate(_binary(batch.column(at))):
            words = words_of(text.as_py() or b"")
            rows.append(np.fromiter(map(number, words, itertools.repeat(0)), np.int32, len(words)))
            size += len(words) + 1
            if size >= shard_words:
                yield [*pieces, batch.slice(begin, i + 1 - begin)], Shard.of(rows, reach)
                pieces, rows, size, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            pieces.append(batch.slice(begin))
    if rows:
        yield pieces, Shard.of(rows, reach)


def _probes(benchmark: DataFrame, window: int, slice_bytes: int, piece_words: int) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark in slices of about ``slice_bytes``, one after the other on the driver, and whether each is the last."""
    lower = F.translate(F.coalesce(benchmark["text"], F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(1)).alias("all_words"))
    items = items.filter(F.size("all_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all_words") - (window - 1)), F.lit(piece_words))
    pieces = items.withColumn("start", F.explode(starts)).select("item", (F.col("start") - 1).alias("start"), F.slice("all_words", F.col("start"), piece_words + window - 1).alias("words")).distinct()
    n_bytes = pieces.select(F.sum(F.octet_length(F.array_join("words", " "))).alias("n")).first()["n"] or 0
    slices = max(1, math.ceil(2 * n_bytes / slice_bytes) if n_bytes > slice_bytes else 1)
    dealt = pieces.withColumn("slice", F.pmod(F.xxhash64("item", "start", "words"), F.lit(slices)))
    for n in range(slices):
        rows = dealt.filter(F.col("slice") == n).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Probe.of([(r["item"], r["start"], r["words"]) for r in rows], window)), n + 1 == slices


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _covered(spans: list[np.ndarray]) -> int:
    """Words in the union of runs."""
    total, end = 0, 0
    for a, b in sorted(tuple(run) for part in spans for run in part.tolist()):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


HITS = "doc_id long, text string, n_words long, spans binary, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """For every document its words, the runs of hit words (pairs of begin and end, eight bytes each) and its items."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"))
    for probe, last in _probes(benchmark, window, slice_bytes, piece_words):
        rows = rows.mapInArrow(_added(probe, shard_words, last), HITS)
        rows = rows if last else written(rows, "decontamination-pass")
    return rows.drop("text")


def _added(probe: Broadcast, shard_words: int, last: bool) -> Callable:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces, shard in _shards(batches, 1, probe.value, shard_words, probe.value.window):
            table = pa.Table.from_batches(pieces)
            spans, items = shard.hits(probe.value)
            before = zip(table["spans"].to_pylist(), table["items"].to_pylist(), strict=True)
            merged = [(old + new.astype("<i8").tobytes(), sorted({*names, *more})) for (old, names), new, more in zip(before, spans, items, strict=True)]
            texts = pa.nulls(len(table), table["text"].type) if last else table["text"]
            lengths = np.diff(np.append(shard.starts, len(shard.ids))) - 1
            yield from pa.table({"doc_id": table["doc_id"], "text": texts, "n_words": pa.array(lengths, pa.int64()), "spans": pa.array([s for s, _ in merged], pa.binary()), "items": pa.array([i for _, i in merged], pa.list_(pa.string()))}).to_batches()

    return found


DIGESTS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, items with windows in it, a hash of their names, and whether it is contaminated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("doc_id", "n_words", "spans", "items")}
            items = columns["items"].to_pylist()
            n_hit = [_covered([np.frombuffer(s, "<i8").reshape(-1, 2)]) for s in columns["spans"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [columns["doc_id"], columns["n_words"], pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(map(_digest, items), pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                [c.split()[0] for c in DIGESTS.split(", ")],
            )

    return hits(docs, benchmark, **options).mapInArrow(rows, DIGESTS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    at = docs.columns.index("text")

    def clean(probe: Broadcast) -> Callable:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pieces, shard in _shards(batches, at, probe.value, shard_words, probe.value.window):
                spans, _ = shard.hits(probe.value)
                yield from pa.Table.from_batches(pieces).filter(pa.array([not len(s) for s in spans], pa.bool_())).to_batches()

        return kept

    for probe, last in _probes(benchmark, window, slice_bytes, piece_words):
        docs = docs.mapInArrow(clean(probe), docs.schema)
        docs = docs if last else written(docs, "decontamination-pass")
    return docs


MATCHES = "item string, item_word long, length long, locations long, doc_id long, doc_word long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard_words: int = SHARD_WORDS, slice_bytes: int = SLICE_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """For every test suffix with a match of ``least`` words or more: the longest verbatim match in any document, in how many places it stands, and the first (least id, then word).

    Within an item of more than ``piece_words`` words a match ends with its piece.
    """

    def searched(probe: Broadcast) -> Callable:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = probe.value
            starts = np.arange(len(test.words))
            for pieces, shard in _shards(batches, 1, test, shard_words, int(test.left.max(initial=1))):
                ids = [i for piece in pieces for i in piece.column(0).to_pylist()]
                depth, low, high = search(shard.ids, shard.places, test.words, starts, test.left)
                rows = []
                for k in np.flatnonzero(depth >= least).tolist():
                    at = shard.places[low[k] : high[k]]
                    documents = shard.documents(at)
                    doc_id, word = min(((ids[d], int(p - shard.starts[d])) for d, p in zip(documents.tolist(), at.tolist(), strict=True)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
                    rows.append((test.items[test.item[k]], int(test.place[k]), int(depth[k]), len(at), doc_id, word))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == 0 else pa.int64()) for n, c in enumerate(columns)], [c.split()[0] for c in MATCHES.split(", ")])

        return found

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    every = reduce(DataFrame.unionAll, (rows.mapInArrow(searched(probe), MATCHES) for probe, _ in _probes(benchmark, least, slice_bytes, piece_words)))
    by_length = every.groupBy("item", "item_word", "length").agg(F.sum("locations").alias("locations"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc_word")).alias("first"))
    best = by_length.groupBy("item", "item_word").agg(F.max_by(F.struct("length", "locations", "first"), "length").alias("best"))
    return best.select("item", "item_word", "best.length", "best.locations", "best.first.doc_id", "best.first.doc_word")
