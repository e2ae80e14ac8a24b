"""Operator 2: sum-of-squares online packing of token sequences.

Documents come in the order of their input partition.  A document of more than
``capacity`` tokens first gives off full sequences; what is left of it is an
item of fewer than ``capacity`` tokens.  ``N[h]`` counts the open sequences
that hold ``h`` tokens.  An item of ``s`` tokens goes to the level ``h`` for
which the sum of all ``N[h]**2`` becomes smallest: moving a sequence from level
``h`` to ``h + s`` changes it by ``2 * (N[h + s] - N[h]) + 2``.  Full sequences
are not counted.  Level 0 stands for a new sequence.

When a partition ends, the emptiest open sequences are emptied into the others,
until one is left: each of their pieces goes whole to the level at which the
squares become least, or, if it fits nowhere, is cut to fill the emptiest one.
What the others hold stays as it was placed, and a partition pads one sequence
at most.  The same happens down to half of ``max_open`` when more than that are
open, so memory stays bounded.

No shuffle takes place unless an ``order`` is asked for: each input partition
packs its own documents, and a sequence id is the partition's number in its
upper bits and a running number in its lower 40 bits.  Scans deal the same rows
to the same partitions again, so a task that is run anew gives the same
sequences.  With an ``order``, rows are range-sorted by it first, so sequence
ids follow it from partition to partition.

Cases: a null or empty text is the end token alone; rows with equal or null ids
are documents of their own; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from ledgerloom.llm.workspace import shuffle_width

END_TOKEN = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A space between white space and white space (or the end) may belong to a longer pre-token.
_UNSAFE_SPACE = re.compile(r"\s (?:\s|\Z)")


class ByteBpe:
    """Token ids of a byte-level BPE as little-endian unsigned 32-bit bytes.

    The vocabulary is read from a rank file.  Pre-tokens never reach across a
    space that starts a word, so texts are encoded word by word, and the ids of
    frequent words are kept (``cache_size`` of them; then the cache starts
    anew).  Texts with white space of other shapes are encoded whole.  ``added``
    holds the tokens that the vocabulary's tokenizer finds in a text before all
    else, with their ids.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None, cache_size: int = 500_000, longest_cached: int = 40) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._added = {token: np.array([n], "<u4").tobytes() for token, n in (added or {}).items()}
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._cache: dict[str, bytes] = {}
        self._size, self._longest = cache_size, longest_cached

    def _ids(self, text: str) -> bytes:
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._ids(" " + word)
        if len(word) <= self._longest:
            if len(self._cache) >= self._size:
                self._cache.clear()
            self._cache[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self._at_added and self._at_added.search(text):
            return b"".join(self._added.get(part) or self._plain(part) for part in self._at_added.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _UNSAFE_SPACE.search(text):
            return self._ids(text)
        first, *words = text.split(" ")
        kept, word = self._cache.get, self._word
        return (self._ids(first) if first else b"") + b"".join([kept(w) or word(w) for w in words])


def byte_bpe_50k() -> ByteBpe:
    """The ids of ``byte_bpe_50k.json``: its added tokens from there, all others from the rank file of the same vocabulary."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


class SumOfSquaresPacker:
    """Packs items into sequences. A piece is (document's row, start, token ids)."""

    def __init__(self, capacity: int, max_open: int) -> None:
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.n_emptied = 0  #: Sequences whose pieces went to others

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Take a document; yield the sequences that are full now."""
        start = 0
        while len(ids) - start >= self.capacity:
            yield [(doc, start, ids[start : start + self.capacity])]
            start += self.capacity
        if start < len(ids):
            yield from self._place((doc, start, ids[start:].copy()))
        if self.n_open > self.max_open:
            yield from self._empty(max(1, self.max_open // 2))

    def level(self, size: int, new: bool = True) -> int:
        """The fill level that an item of ``size`` tokens goes to; of equally good ones, the fullest. 0: a new sequence (or, if ``new`` is not set, none)."""
        n, top = self.counts, self.capacity - size
        after = n[size:].copy()  # N[h + size] for h from 0 to top
        after[-1] = 0  # a full sequence counts no more
        change = 2 * (after - n[: top + 1]) + 2
        if top:
            change[-1] -= 1  # only its old level changes
        change[0] = 2 * after[0] + 1 if new else np.iinfo(np.int64).max
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = int(top - np.argmin(change[::-1]))
        return best if new or n[best] else 0

    def _place(self, piece: tuple) -> Iterator[list[tuple]]:
        yield from self._put(self.level(len(piece[2])), piece)

    def _put(self, level: int, piece: tuple) -> Iterator[list[tuple]]:
        sequence = self._take(level) if level else []
        sequence.append(piece)
        filled = level + len(piece[2])
        if filled == self.capacity:
            yield sequence
        else:
            self.open.setdefault(filled, []).append(sequence)
            self.counts[filled] += 1
            self.n_open += 1

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _emptiest(self) -> int:
        return int(np.argmax(self.counts > 0))

    def _empty(self, most: int) -> Iterator[list[tuple]]:
        """Empty the emptiest open sequences into the others, until ``most`` are open."""
        while self.n_open > most:
            self.n_emptied += 1
            for doc, start, ids in self._take(self._emptiest()):
                while len(ids):
                    level, used = self.level(len(ids), new=False), len(ids)
                    if not level and self.n_open:
                        level = self._emptiest()
                        used = self.capacity - level
                    yield from self._put(level, (doc, start, ids[:used]))
                    start, ids = start + used, ids[used:]

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._empty(1)
        yield from (sequence for sequences in self.open.values() for sequence in sequences)


def pack(docs: DataFrame, capacity: int = 2048, max_open: int = 4096, tokenizer: Callable[[], Callable[[str], bytes]] = byte_bpe_50k, order: Sequence[Column] = ()) -> DataFrame:
    """One row for each piece: its document, its place in it, its sequence and its place there. ``order``: what sequences are to follow."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(), SumOfSquaresPacker(capacity, max_open)
        end = np.array([END_TOKEN], "<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def give(sequences: Iterator[list[tuple]]) -> None:
            nonlocal sequence_id
            for sequence in sequences:
                offset = 0
                for (doc_id, n_tokens), start, ids in sequence:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n_tokens, sequence_id, offset))
                    offset += len(ids)
                sequence_id += 1

        names = [field.split()[0] for field in SCHEMA.split(", ")]

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py() or "") + end, "<u4")
                give(packer.add((doc_id, len(ids)), ids))
                if len(rows) >= 10_000:
                    yield flushed()
        give(packer.finish())
        if rows:
            yield flushed()

    if order:
        names_of = [f"__order_{i}" for i in range(len(order))]
        docs = docs.select(*(column.alias(name) for column, name in zip(order, names_of, strict=True)), docs["doc_id"], docs["text"])
        docs = docs.repartitionByRange(shuffle_width(docs.sparkSession), *names_of).sortWithinPartitions(*names_of)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(packed, SCHEMA)
