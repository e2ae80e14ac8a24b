"""Operator 8: removal of repeated word passages, found by recompression.

A window is 13 consecutive words of one document.  A word goes if
a window over it also starts in a document with a smaller doc_id.

Names.  A word's name is a 64-bit hash of it.  One level of recompression names
runs of equal words (a hash of the word's name and the length), splits all
names into left and right ones by a hashed coin, and gives each adjacent
left-right pair a name of its own (a hash of both).  The next level does the
same to what came out, where equal neighbours share a coin and so stay apart.
A name depends on what it stands for alone, so naming needs no exchange between
tasks, and equal passages get equal symbols but for those at their ends, which
can be joined with what stands outside.  Two levels are what 13 words leave
room for: a border between symbols of the third can depend on words outside.

Anchors.  In a window without equal adjacent words, the borders between
second-level symbols at word 3 to 10 do not depend on the words outside, and
four neighbouring places hold at least one.  The anchor of a window is such a
border between places 3 and 9, where the name of the seven words around it is
least.  Equal windows have equal anchors, and one anchor serves about four
windows.  A window with equal adjacent words is its own anchor.  A window's
symbol is named by its anchor and what stands around it.

Texts are dealt to blocks of about ``block_bytes`` by hash, once; all rounds
read that one shuffle.

Round 1.  A block names its words and windows, and gives the windows' symbols (32
bits of each, once) to the symbols' buckets.
Round 2.  A bucket tells blocks which of their symbols another block has too.
Round 3.  A block finds its windows that also start in a smaller document of the
block (so a passage that very many documents share leaves each block just once),
and gives the words of the others to the anchors' buckets, if their symbol is
shared: neighbours with one anchor together.  A phrase that is common but stands
in ever other surroundings is anchor to many windows, but they are not shared.
Round 4.  A bucket compares the words and reports windows that a smaller
document of another block has too.
Round 5.  A block cuts its texts.

Symbols and anchors only say where to look.  Within a block and within a bucket,
windows are equal if their words are (``_classes``), whatever their hashes.

The numbers of blocks and buckets follow the bytes of all texts, so what a task
holds at once is a block, or the symbols or shared windows of a bucket.

Cases: a null text has no words; texts of fewer than 13 words lose none; of rows
with equal ids none is smaller; rows with a null id are left whole and take
nothing from others; an empty table gives no rows; other columns, whatever
their names, are passed on by ``deduplicated`` and not read by ``digests``.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workspace import shuffle_width

WINDOW = 13
AROUND = (3, 4)  #: Words before and after a border whose name is the border's
FIRST, LAST = 3, 9  #: Places of a window where its anchor can be
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 64 << 20  #: Bytes of text for one bucket

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit names evenly."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _paired(names: np.ndarray, borders: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One round of pair naming. ``borders``: True where a symbol may not be joined with the one before it."""
    coins = _mix(names + np.uint64(level)) & np.uint64(1)
    joins = np.zeros(len(names), bool)
    joins[1:] = (coins[:-1] == 0) & (coins[1:] == 1) & ~borders[1:]
    heads = np.nonzero(~joins)[0]
    named = names[heads]
    with_next = np.zeros(len(names) + 1, bool)
    with_next[:-1] = joins
    pairs = with_next[heads + 1]
    named[pairs] = _joined(names[heads[pairs]], names[heads[pairs] + 1])
    return heads, named


def symbol_borders(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a second-level symbol starts at each word. ``starts``: whether a document starts there."""
    n = len(words)
    run_starts = starts.copy()
    run_starts[1:] |= words[1:] != words[:-1]
    run_starts[0] = True
    at = np.nonzero(run_starts)[0]
    lengths = np.diff(at, append=n)
    names = words[at].copy()
    long = lengths > 1
    names[long] = _joined(names[long], lengths[long].astype(np.uint64))
    for level in (1, 2):
        heads, names = _paired(names, starts[at], level)
        at = at[heads]
    found = np.zeros(n, bool)
    found[at] = True
    return found


def _names(index: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))


def _name_of_next(words: np.ndarray, count: int) -> np.ndarray:
    """The name of the ``count`` words from each word on (of fewer at the block's end), joined of names of 1, 2, 4 and more words."""
    after = lambda names, k: np.concatenate([names[k:], np.zeros(min(k, len(names)), np.uint64)])
    found, done, power, span = None, 0, words, 1
    while span <= count:
        if count & span:
            found = power if found is None else _joined(found, after(power, done))
            done += span
        if 2 * span <= count:
            power = _joined(power, after(power, span))
        span *= 2
    return found


def _binary(texts: pa.ChunkedArray) -> pa.ChunkedArray:
    return texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())


def _numbered(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """All words of all texts, one text after the other, by number; the word of each number; how many words each text has (null: none)."""
    joined = texts.cast(pa.large_binary()).combine_chunks()
    if joined.null_count:
        joined = joined.fill_null(b"")
    _, offsets, data = joined.buffers()
    ends = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = (letters != 0x20) & (letters - np.uint8(9) > 4)  # not [\x20\x09-\x0D]
    edge = np.zeros(len(letters) + 1, bool)
    edge[ends] = True
    begins, stops = edge[:-1].copy(), edge[1:].copy()
    begins[1:] |= ~inside[:-1]
    stops[:-1] |= ~inside[1:]
    begin, stop = np.nonzero(begins & inside)[0], np.nonzero(stops & inside)[0]
    bounds = np.concatenate([[0], np.cumsum(stop + 1 - begin)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(letters[inside])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, np.diff(np.searchsorted(begin, ends))


def _spaced(words: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The words up to each end, joined by spaces."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), words), pa.scalar(b" ", pa.large_binary()))


def _ordered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names are neighbours, and where one begins that differs from the one before it, judged by the bits that their places leave free."""
    low = np.uint64((1 << len(names).bit_length()) - 1)
    placed = np.sort((names & ~low) | np.arange(len(names), dtype=np.uint64))
    first = np.ones(len(names), bool)
    first[1:] = (placed[1:] ^ placed[:-1]) > low
    return (placed & low).astype(np.int64), first


def _classes(at: np.ndarray, name: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for each window that starts at ``at``: equal if, and only if, the words are. ``name``: a hash of each window; ``words``: word numbers."""
    order, first = _ordered(name)
    group = np.cumsum(first) - 1
    sizes = np.bincount(group, minlength=1)
    several = np.nonzero(sizes[group] > 1)[0]
    own, of_first = at[order[several]], at[order[np.nonzero(first)[0][group[several]]]]
    same = np.ones(len(several), bool)
    for i in range(WINDOW):
        same &= words[own + i] == words[of_first + i]
    found = np.empty(len(at), np.int64)
    found[order] = group
    if not same.all():  # different words under one hash
        clash = np.isin(found, group[several[~same]])
        exact: dict[bytes, int] = {}
        found[clash] = [len(at) + exact.setdefault(words[i : i + WINDOW].tobytes(), len(exact)) for i in at[clash]]
    return found


def _least(classes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the least id of its class."""
    least = np.full(classes.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, ids)
    return least[classes]


def _elsewhere(at: np.ndarray, name: np.ndarray, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a window of the same words has a smaller id. Windows whose hash stands once are not looked at."""
    order, first = _ordered(name)
    some = np.sort(order[~(first & np.append(first[1:], True))])
    gone = np.zeros(len(at), bool)
    gone[some] = ids[some] > _least(_classes(at[some], name[some], words), ids[some])
    return gone


class _Block:
    """The words of a block's texts, one text after the other; texts without a window are left out."""

    def __init__(self, table: pa.Table) -> None:
        ids = table["__substrings_id"].combine_chunks()
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        ids, keys = (np.asarray(column.fill_null(0)) for column in (ids, table["__substrings_key"].combine_chunks()))
        words, self.index, lengths = _numbered(table["text"])
        used = named & (lengths >= WINDOW)
        self.words = words[np.repeat(used, lengths)]
        self.ids, self.keys, lengths = ids[used], keys[used], lengths[used]
        offsets = np.cumsum(lengths) - lengths
        self.starts = np.zeros(len(self.words), bool)
        self.starts[offsets] = True
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(self.words)) - offsets[self.row]
        self.windows = np.nonzero(self.place <= lengths[self.row] - WINDOW)[0]
        self.names = _names(_spaced(self.index, np.array([len(self.index)]))[0].as_py().split(b" "))[self.words] if len(self.words) else np.zeros(0, np.uint64)
        self.window_names = _name_of_next(self.names, WINDOW)

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        names, n = self.names, len(self.names)
        if not n:
            return names
        equal = np.zeros(n, np.int64)
        equal[1:] = (names[1:] == names[:-1]) & ~self.starts[1:]
        sums = np.concatenate([np.cumsum(equal), np.full(WINDOW, equal.sum())])
        stutters = sums[WINDOW - 1 : WINDOW - 1 + n] > sums[:n]
        around = np.zeros(n, np.uint64)
        around[AROUND[0] :] = _name_of_next(names, sum(AROUND))[: n - AROUND[0]]
        none = np.uint64(2**64 - 1)
        place_name = np.concatenate([np.where(symbol_borders(names, self.starts), around, none), np.full(WINDOW, none)])
        anchor = place_name[FIRST : FIRST + n].copy()
        for i in range(FIRST + 1, LAST + 1):
            np.minimum(anchor, place_name[i : i + n], out=anchor)
        own = stutters | (anchor == none)
        anchor[own] = self.window_names[own]
        return anchor[self.windows]

    def symbols(self, anchors: np.ndarray) -> np.ndarray:
        return _joined(anchors, self.window_names[self.windows])


def _addressed(symbols: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each symbol, and in the lower 32 bits what is sent there."""
    return (symbols % np.uint64(buckets)) << np.uint64(32) | symbols >> np.uint64(32)


def _sent(table: pa.Table) -> list[np.ndarray]:
    """The 32 bits of the symbols of each row."""
    return [np.frombuffer(blob.as_py(), "<u4") for blob in table["symbols"]]


def _cut_by(values: np.ndarray) -> zip:
    """Begin and end of each run of equal values."""
    cuts = np.nonzero(np.diff(values, prepend=values[:1] - 1))[0] if len(values) else np.zeros(0, np.int64)
    return zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=False)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the values that are wanted, of which there is one at least. Most others are told by their lowest bits."""
    low = np.uint64((1 << 22) - 1)
    marked = np.zeros(1 << 22, bool)
    marked[wanted & low] = True
    maybe = np.nonzero(marked[values & low])[0]
    wanted = np.sort(wanted)
    return maybe[wanted[np.searchsorted(wanted, values[maybe]).clip(max=len(wanted) - 1)] == values[maybe]]


def _spans(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """The owners of windows that go, each once, and their windows as runs of ``(first place, number)``. The windows stand in the order of owner and place."""
    breaks = np.ones(len(owner), bool)
    breaks[1:] = (owner[1:] != owner[:-1]) | (np.diff(place) != 1)
    heads = np.nonzero(breaks)[0]
    spans = np.stack([place[heads], np.diff(heads, append=len(owner))], axis=1).astype("<u4")
    owner = owner[heads]
    cuts = np.nonzero(np.diff(owner, prepend=-1))[0]
    ends = (8 * np.append(cuts, len(heads))).astype(np.int32)
    return owner[cuts], pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(spans)])


SYMBOLS = "__substrings_block long, bucket long, symbols binary"


def _named(table: pa.Table, buckets: int) -> pa.Table:
    """Round 1."""
    block = _Block(table)
    symbols = np.sort(_addressed(block.symbols(block.anchors()), buckets))
    symbols = symbols[np.diff(symbols, prepend=~symbols[:1]) != 0]
    bucket = (symbols >> np.uint64(32)).astype(np.int64)
    rows = [(int(bucket[lo]), symbols[lo:hi].astype("<u4").tobytes()) for lo, hi in _cut_by(bucket)]
    number = table["__substrings_block"][0].as_py()
    return pa.table({"__substrings_block": pa.array([number] * len(rows), pa.int64()), "bucket": pa.array([b for b, _ in rows], pa.int64()), "symbols": pa.array([a for _, a in rows], pa.binary())})


def _shared(table: pa.Table) -> pa.Table:
    """Round 2. A block names 32 bits once, so those that stand twice have two blocks (of symbols alike in them, which costs work alone)."""
    parts = _sent(table)
    every = np.concatenate(parts)
    placed = np.sort(every.astype(np.uint64) << np.uint64(32) | np.arange(len(every), dtype=np.uint64))
    alike = placed[1:] >> np.uint64(32) == placed[:-1] >> np.uint64(32)
    again = np.zeros(len(every), bool)
    for one in (placed[1:][alike], placed[:-1][alike]):
        again[one & np.uint64(2**32 - 1)] = True
    ends = np.cumsum([len(part) for part in parts])
    blobs = [part[again[end - len(part) : end]].tobytes() for part, end in zip(parts, ends.tolist(), strict=True)]
    out = pa.table({"__substrings_block": table["__substrings_block"], "bucket": table["bucket"], "symbols": pa.array(blobs, pa.binary())})
    return out.filter(pa.array([bool(blob) for blob in blobs], pa.bool_()))


WINDOWS = "__substrings_block long, bucket long, doc_id long, text_key long, spans binary, owners binary, places binary, counts binary, words binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _compared(table: pa.Table, shared: pa.Table, buckets: int) -> pa.Table:
    """Round 3. A row is a report (with spans), or a block's windows for a bucket: documents, and for each run of windows its owner, first place, number and words."""
    rows: list[tuple] = []
    block = _Block(table)
    if len(block.windows):
        number = table["__substrings_block"][0].as_py()
        at = block.windows
        owner, place = block.row[at], block.place[at]
        gone = _elsewhere(at, block.window_names[at], block.words, block.ids[owner])
        of, spans = _spans(owner[gone], place[gone])
        rows += [(number, doc_id % buckets, doc_id, key, span, None, None, None, None) for doc_id, key, span in zip(block.ids[of].tolist(), block.keys[of].tolist(), spans.to_pylist(), strict=True)]
        if shared.num_rows:
            anchor = block.anchors()
            wanted = np.concatenate([part.astype(np.uint64) | np.uint64(bucket << 32) for bucket, part in zip(shared["bucket"].to_pylist(), _sent(shared), strict=True)])
            left = np.nonzero(~gone)[0]
            kept = left[_among(_addressed(block.symbols(anchor)[left], buckets), wanted)]
            bucket = (anchor[kept] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            kept, bucket = kept[order], bucket[order]
            breaks = np.ones(len(kept), bool)
            breaks[1:] = (np.diff(at[kept]) != 1) | (owner[kept[1:]] != owner[kept[:-1]]) | (bucket[1:] != bucket[:-1])
            heads = np.nonzero(breaks)[0]
            counts, bucket = np.diff(heads, append=len(kept)), bucket[heads]
            kept = kept[heads]
            ends = np.cumsum(counts + WINDOW - 1)
            inside = np.repeat(at[kept] - (ends - (counts + WINDOW - 1)), counts + WINDOW - 1) + np.arange(ends[-1] if len(ends) else 0)
            cuts = list(_cut_by(bucket))
            words = _spaced(block.index.take(pa.array(block.words[inside])), np.array([ends[hi - 1] for _, hi in cuts], np.int64))
            owners = np.stack([block.ids[owner[kept]], block.keys[owner[kept]]], axis=1).astype("<i8")
            places, counts = place[kept].astype("<u4"), counts.astype("<u4")
            rows += [(number, int(bucket[lo]), None, None, None, owners[lo:hi].tobytes(), places[lo:hi].tobytes(), counts[lo:hi].tobytes(), text) for (lo, hi), text in zip(cuts, words.to_pylist(), strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [field.split()[0] for field in WINDOWS.split(", ")])


_REPORTS = pa.schema([("__substrings_block", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def _verified(table: pa.Table) -> pa.Table:
    """Round 4. Passes on the reports of round 3, and adds those of windows whose words another block has too."""
    known = table["spans"].is_valid()
    reports, windows = table.filter(known).select(_REPORTS.names).cast(_REPORTS), table.filter(pc.invert(known))
    if not windows.num_rows:
        return reports
    owners, place, count = (np.frombuffer(b"".join(windows[name].to_pylist()), kind).astype(np.int64) for name, kind in (("owners", "<i8"), ("places", "<u4"), ("counts", "<u4")))
    ids, keys = owners.reshape(-1, 2).T
    blocks = np.repeat(windows["__substrings_block"].to_numpy(), pc.binary_length(windows["owners"]).to_numpy() // 16)
    words, _, _ = _numbered(windows["words"])
    run = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
    at = begin[run] + within
    names = _name_of_next(_mix(words.astype(np.uint64) + np.uint64(1)), WINDOW)[at]
    gone = np.nonzero(_elsewhere(at, names, words, ids[run]))[0]
    other = np.zeros(len(count), bool)  # a run of another document than the one before it
    other[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])
    of, spans = _spans(np.cumsum(other)[run[gone]], (place[run] + within)[gone])
    other[0] = True
    first = np.nonzero(other)[0][of]
    found = pa.table({"__substrings_block": blocks[first], "doc_id": ids[first], "text_key": keys[first], "spans": spans}, schema=_REPORTS)
    return pa.concat_tables([reports, found])


REPORTS = "__substrings_block long, pairs binary, lengths binary, spans binary"


def _gathered(reports: pa.Table) -> pa.Table:
    """The reports of a bucket as one row for each block: ids and keys, how many bytes of spans each has, and the spans."""
    reports = reports.sort_by("__substrings_block").combine_chunks()
    block, spans = reports["__substrings_block"].to_numpy(), reports["spans"]
    pairs, lengths, spans = np.stack([reports["doc_id"].to_numpy(), reports["text_key"].to_numpy()], axis=1), pc.binary_length(spans).to_numpy().astype("<u4"), spans.to_pylist()
    rows = [(int(block[lo]), pairs[lo:hi].tobytes(), lengths[lo:hi].tobytes(), b"".join(spans[lo:hi])) for lo, hi in _cut_by(block)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({name: pa.array(c, pa.binary() if i else pa.int64()) for i, (name, c) in enumerate(zip(("__substrings_block", "pairs", "lengths", "spans"), columns, strict=True))})


def _dealt(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with their key and block, and the bytes of all texts."""
    text = docs["text"]
    n_bytes = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / block_bytes))
    keyed = docs.select("*", docs["doc_id"].cast("long").alias("__substrings_id"), F.xxhash64(text).alias("__substrings_key"))
    return keyed.withColumn("__substrings_block", F.pmod(F.xxhash64("__substrings_id", "__substrings_key"), F.lit(blocks))), n_bytes


def _reported(dealt: DataFrame, n_bytes: int, buckets: int | None) -> DataFrame:
    """Rounds 1 to 4: for blocks the ids and keys of documents with windows to remove, and their ``(first word, windows)`` runs, a row from each bucket."""
    buckets = buckets or max(shuffle_width(dealt.sparkSession), math.ceil(n_bytes / BUCKET_BYTES))
    blocks = dealt.groupBy("__substrings_block")
    shared = blocks.applyInArrow(lambda texts: _named(texts, buckets), SYMBOLS).groupBy("bucket").applyInArrow(_shared, SYMBOLS)
    windows = blocks.cogroup(shared.groupBy("__substrings_block")).applyInArrow(lambda texts, symbols: _compared(texts, symbols, buckets), WINDOWS)
    return windows.groupBy("bucket").applyInArrow(lambda windows: _gathered(_verified(windows)), REPORTS)


def removed_words(spans: bytes | list[bytes] | None, n_words: int) -> np.ndarray:
    """Whether each word goes."""
    gone = np.zeros(n_words + 1, np.int64)
    first, count = np.frombuffer(spans if isinstance(spans, bytes) else b"".join(spans or []), "<u4").reshape(-1, 2).astype(np.int64).T
    np.add.at(gone, first, 1)
    np.subtract.at(gone, first + count + WINDOW - 1, 1)
    return np.cumsum(gone)[:-1] > 0


def _pairs(both: bytes | np.ndarray) -> pa.FixedSizeBinaryArray:
    """Ids and keys, each pair as one value."""
    both = pa.py_buffer(both)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), both.size // 16, [None, both])


def _spans_of(texts: pa.Table, reports: pa.Table) -> list[bytes | None]:
    """The spans of each row of a block, one after the other."""
    ids, keys = texts["__substrings_id"].combine_chunks(), texts["__substrings_key"].combine_chunks()
    pairs = _pairs(np.stack([np.asarray(ids.fill_null(0)), np.asarray(keys)], axis=1))
    owners, lengths, spans = (b"".join(reports[name].to_pylist()) for name in ("pairs", "lengths", "spans"))
    found = pc.index_in(_pairs(owners), value_set=pairs).to_numpy()
    ends = np.append(0, np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64))
    order = np.argsort(found, kind="stable")
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(spans)]).take(pa.array(order)).to_pylist()
    by_row = {int(found[order[lo]]): b"".join(parts[lo:hi]) for lo, hi in _cut_by(found[order])}
    first = pc.index_in(pairs, value_set=pairs).to_pylist()  # of equal rows
    return [by_row.get(row) if named else None for row, named in zip(first, ids.is_valid().to_pylist(), strict=True)]


def _digests(texts: pa.Table, reports: pa.Table) -> pa.Table:
    counts, removed, hashes = [], [], []
    for text, spans in zip(_binary(texts["text"]), _spans_of(texts, reports), strict=True):
        words = (text.as_py() or b"").split()
        counts.append(len(words))
        if spans:
            gone = removed_words(spans, len(words))
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        removed.append(counts[-1] - len(words))
        hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": texts["__substrings_id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})


def digests(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the SHA-256 of the kept words, joined by one space, of every row."""
    dealt, n_bytes = _dealt(docs.select("doc_id", "text"), block_bytes)
    reports = _reported(dealt, n_bytes, buckets)
    both = dealt.groupBy("__substrings_block").cogroup(reports.groupBy("__substrings_block"))
    return both.applyInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_text(text: bytes, spans: bytes | list[bytes]) -> bytes:
    """The text without the words that go and the white space behind each; the rest stays as it stands."""
    pieces = []
    words = list(_WORD.finditer(text))
    gone = removed_words(spans, len(words))
    at = 0
    for i in np.nonzero(gone)[0]:
        end = words[i + 1].start() if i + 1 < len(words) else len(text)
        pieces.append(text[at : words[i].start()])
        at = end
    pieces.append(text[at:])
    return b"".join(pieces)


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, repeated passages cut from ``text`` (and ``n_chars`` counted anew where there is one)."""
    names = docs.columns

    def cut(texts: pa.Table, reports: pa.Table) -> pa.Table:
        own = _binary(texts["text"])
        kept = [kept_text(t.as_py(), s) if s else t.as_py() for t, s in zip(own, _spans_of(texts, reports), strict=True)]
        at = texts.column_names.index("text")
        return texts.set_column(at, "text", pa.array(kept, own.type).cast(texts["text"].type)).select(names)

    dealt, n_bytes = _dealt(docs, block_bytes)
    reports = _reported(dealt, n_bytes, buckets)
    out = dealt.groupBy("__substrings_block").cogroup(reports.groupBy("__substrings_block")).applyInArrow(cut, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
