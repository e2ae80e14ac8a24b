"""Operator 5: quality rules as a short-circuit cascade.

A rule rejects a document by a few statistics of its whole text.  A statistic
is computed when the first rule asks for it and kept for the rules after it.
Before the run, a bounded sample of ``sample_rows`` texts, those of the least
hashes of their ids in the whole table, is put through the rules on the
driver.  The order is built greedily, each time by the rule that rejects most of
what the rules before it let through, per second; its cost is the time that it
takes beyond the statistics that those rules have left behind (``screened`` returns
some statistics of every text and plans with these as given).  Every document then runs through the rules
in that order and leaves at the first that rejects it.  All rules of a set must
hold, so the order changes the work and never the verdict.

The work is one pass over the input partitions, without a shuffle.

Cases: a null text is one without words; empty texts and texts without words
fail the least number of words; very long texts are read whole; rows with equal
ids are judged one by one; an empty table gives no rows (and the rules keep
their declared order); other columns are passed on by ``filtered`` and not read
by ``screened``.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Maps every byte to itself; bytes that start no code point, and white space, are deleted.
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + _SPACE
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


class Statistics:
    """Statistics of one UTF-8 text, each computed at most once, when it is asked for."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text.translate(None, _NOT_SYMBOLS))

    @cached_property
    def n_exclamations(self) -> int:
        return self.text.count(b"!")

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.text.split(b"\n") if line.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that the text holds twice or more."""
        words = self.words
        if len(set(zip(words, words[1:], words[2:], strict=False))) == max(0, len(words) - 2):
            return 0
        first: dict[tuple, int] = {}
        covered = bytearray(len(words))
        for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
            at = first.setdefault(window, i)
            if at != i:
                covered[at : at + 3] = covered[i : i + 3] = b"\1\1\1"
        return sum(covered)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before them."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Statistics], bool]


BASE_RULES = (
    Rule("few words", lambda s: s.n_words < 50),
    Rule("repeated windows", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("exclamations", lambda s: 10 * s.n_exclamations > 3 * s.n_words),
    Rule("repeated lines", lambda s: 10 * s.n_dup_lines > 4 * s.n_lines),
    Rule("word length", lambda s: not 3 * s.n_words <= s.word_chars <= 10 * s.n_words),
    Rule("stutter", lambda s: 5 * s.n_stutters > s.n_words),
)


def cascade(sample: Sequence[bytes], rules: Sequence[Rule], clock: Callable[[], float] = time.perf_counter, given: Sequence[str] = ()) -> list[Rule]:
    """The rules in the order of what each rejects per second, given those before it. ``given``: statistics that are there already."""
    left, order, remaining = [Statistics(text) for text in sample], [], list(rules)
    for statistics in left:
        for name in given:
            getattr(statistics, name)
    while remaining:
        tried = {}
        for rule in remaining:
            known = [copy.copy(statistics) for statistics in left]  # what the rules before have computed, no more
            began = clock()
            rejected = [rule.rejects(statistics) for statistics in known]
            tried[rule.name] = sum(rejected) / max(clock() - began, 1e-9), known, rejected
        best = max(remaining, key=lambda rule: tried[rule.name][0])
        remaining.remove(best)
        order.append(best)
        _, known, rejected = tried[best.name]
        left = [statistics for statistics, gone in zip(known, rejected, strict=True) if not gone]
    return order


def planned(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 200, given: Sequence[str] = ()) -> list[Rule]:
    """The cascade for ``docs``, from a sample of at most ``sample_rows`` of its texts, drawn by hash over the whole table. The draw reads the ids alone."""
    keys = docs.select(F.xxhash64(docs["doc_id"]).alias("key"))
    last = keys.orderBy("key").limit(sample_rows).agg(F.max("key")).first()[0]
    if last is None:
        return list(rules)
    sample = docs.filter(F.xxhash64(docs["doc_id"]) <= last).select("text").limit(sample_rows)  # repeated ids may make more
    return cascade([(row[0] or "").encode() for row in sample.collect()], rules, given=given)


def passes(statistics: Statistics, order: Sequence[Rule]) -> bool:
    return not any(rule.rejects(statistics) for rule in order)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def screened(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, sample_rows: int = 200) -> DataFrame:
    """Statistics and verdicts of every row: ``base_failed`` by the base rules, ``kept`` by all rules (which ``rules`` holds)."""
    order = planned(docs, rules, sample_rows, COLUMNS)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in COLUMNS]
            failed, kept = [], []
            for text in batch.column(1).cast(pa.binary()):
                s = Statistics(text.as_py() or b"")
                for column, name in zip(columns, COLUMNS, strict=True):
                    column.append(getattr(s, name))
                failed.append(not passes(s, base))
                kept.append(passes(s, order))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *COLUMNS, "base_failed", "kept"])

    schema = f"doc_id long, {', '.join(f'{name} long' for name in COLUMNS)}, base_failed boolean, kept boolean"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(judged, schema)


def filtered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 200) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order = planned(docs, rules, sample_rows)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([passes(Statistics(text.as_py() or b""), order) for text in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
