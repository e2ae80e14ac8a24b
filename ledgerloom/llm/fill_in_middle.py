"""Operator 11: fill-in-middle transformation by run-length class encoding.

A text is stored as its maximal runs of characters of one class, each with the
units that end up to the run's end.  The run that a cut falls into is found by
binary search in these counts, and the place of the cut within the run by
arithmetic, so no list of units is ever made:

- ``LINES``: line feeds (each ends a unit) and all others (end none themselves);
- ``WORDS``: white space (ends none) and all others (one unit a run);
- ``CHARS``: code points of one, two, three or four bytes (each is a unit).

What stands at the end of a text and ends no unit is the last unit.

A document's cuts, and whether and how it is rearranged, come from a hash of
``seed`` and its id, so they do not depend on the other rows.  ``psm`` puts
prefix, suffix and middle behind their marks, ``spm`` suffix, prefix and middle,
and ``plain`` leaves the text as it is.  A text that holds a mark stays plain:
so the first mark after another's start is always the real one, and ``restored``
gives back the exact text.

The work is one pass over the input partitions, without a shuffle; a task holds
one batch of rows.

Cases: a null text is an empty one, and empty texts stay plain; a null id hashes
as an id without digits; very long texts are cut as whole; repeated rows and rows
with equal ids are treated one by one (equal ids draw the same numbers); an empty
table gives no rows; other columns, whatever their names, are passed on by
``transformed`` and not read by ``digests``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EACH, LAST, NONE = 1, 2, 0  #: Units end with each character of a run, with its last one, or with none


@dataclass(frozen=True)
class Units:
    """The class of a character by its first byte, and for each class where units end."""

    classes: bytes
    ends: tuple[int, ...]


def _two_classes(special: bytes, ends: tuple[int, int]) -> Units:
    return Units(bytes(b in special for b in range(256)), ends)


LINES = _two_classes(b"\n", (NONE, EACH))
WORDS = _two_classes(b" \t\n\v\f\r", (LAST, NONE))
CHARS = Units(bytes((b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) for b in range(256)), (EACH, EACH, EACH, EACH))


class Runs:
    """The runs of a UTF-8 text. ``units``: units that end up to each run's end."""

    def __init__(self, text: bytes, kind: Units) -> None:
        data = np.frombuffer(text, np.uint8)
        firsts = np.flatnonzero((data & 0xC0) != 0x80)
        classes = np.frombuffer(kind.classes, np.uint8)[data[firsts]]
        heads = np.flatnonzero(np.diff(classes, prepend=255))
        self.chars = np.append(heads, len(firsts))
        self.bytes = np.append(firsts[heads], len(data))
        self.ends = np.array(kind.ends, np.uint8)[classes[heads]]
        if len(heads) and self.ends[-1] == NONE:
            self.ends[-1] = LAST
        self.units = np.cumsum(np.select([self.ends == EACH, self.ends == LAST], [np.diff(self.chars), 1], 0))

    def __len__(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, n: int) -> tuple[int, int]:
        """Where the first ``n`` units end: in bytes and in characters."""
        if n == 0:
            return 0, 0
        run = int(np.searchsorted(self.units, n))
        if self.ends[run] != EACH:
            return int(self.bytes[run + 1]), int(self.chars[run + 1])
        into = n - (int(self.units[run - 1]) if run else 0)
        width = int(self.bytes[run + 1] - self.bytes[run]) // int(self.chars[run + 1] - self.chars[run])
        return int(self.bytes[run]) + into * width, int(self.chars[run]) + into


@dataclass(frozen=True)
class Plan:
    """``rate``: percent of texts that are rearranged; ``spm``: percent of these with the suffix first; ``marks``: of prefix, suffix and middle."""

    units: Units = LINES
    rate: int = 100
    spm: int = 50
    seed: int = 7
    marks: tuple[bytes, bytes, bytes] = (b"<P>", b"<S>", b"<M>")


@dataclass(frozen=True)
class Cut:
    units: int
    form: str
    output: bytes
    prefix_chars: int | None = None
    middle_chars: int | None = None


def rearranged(text: bytes, doc_id: int | None, plan: Plan = Plan()) -> Cut:
    runs = Runs(text, plan.units)
    n = len(runs)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= plan.rate or any(mark in text for mark in plan.marks):
        return Cut(n, "plain", text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_chars), (b, b_chars) = runs.cut(first), runs.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = plan.marks
    form = "spm" if h4 % 100 < plan.spm else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return Cut(n, form, b"".join(parts), a_chars, b_chars - a_chars)


def restored(output: bytes, form: str, marks: tuple[bytes, bytes, bytes] = Plan.marks) -> bytes:
    """The text that ``rearranged`` was given."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    head, rest = output[len(first) :].split(second, 1)
    tail, middle = rest.split(m, 1)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def _binary(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())


def transformed(docs: DataFrame, plan: Plan = Plan(), form: str = "fim_form") -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` rearranged (and ``n_chars`` counted anew where there is one); the column ``form`` says how."""
    names = docs.columns
    key = docs["doc_id"].cast("long").alias("__fim_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns[:-1], strict=True))
            cuts = [rearranged(t.as_py() or b"", i, plan) for t, i in zip(_binary(columns["text"]), batch.column(len(names)).to_pylist(), strict=True)]
            texts = pa.array([cut.output for cut in cuts], pa.large_binary()).cast(pa.large_string())
            columns["text"] = texts.cast(columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t.as_py()) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            columns[form] = pa.array([cut.form for cut in cuts], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = docs.withColumn(form, docs["text"].cast("string")).schema
    return docs.select("*", key).mapInArrow(rows, schema)


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Units, form, lengths and hashes of the output and of what is rebuilt from it, for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), strict=True):
                cut = rearranged(text.as_py() or b"", doc_id, plan)
                again = restored(cut.output, cut.form, plan.marks)
                out.append((doc_id, cut.units, cut.form, cut.prefix_chars, cut.middle_chars, hashlib.sha256(cut.output).hexdigest(), hashlib.sha256(again).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(rows, DIGESTS)
