"""Vendor renames: greedy clusters of names, elected in rounds.

In the order in which names first appear, each joins the first leader before it that
is alike by 55 to 99 percent, or leads itself.  At 55 percent two names of 20 letters
may be 9 edits apart, so two pairs of neighbouring letters are all they must share:
an index of pieces would meet nearly every pair.  But names are compared with
leaders alone, and a name with a leader is done.  So a round

1. takes the first ``per_round`` names that are left and elects the leaders among them,
2. compares all others with these new leaders: the first one alike is theirs.

What is left then is alike to no leader so far, so the next round's election is exact.
A task holds the new leaders (``per_round`` names at most, the one thing that is
broadcast) and a batch of names; nothing is grouped, and no pairs are written.

A comparison is arithmetic on whole tiles of names and leaders: lengths and counts of
letters, which bound the edit distance from below, rule most pairs out; the others
get their distance by bit-parallel dynamic programming, all at a time (Myers 1999,
one 64-bit column a pair; names over 64 letters one by one).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.staging import staged

ALIKE = 55
_CLASSES = 32
_WORD = 64
_TILE = 1 << 22  #: Pairs that are looked at together


class Names:
    """Names as numbers: their letters, lengths, and counts of letters by class."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts = list(texts)
        self.lengths = np.array([len(t) for t in self.texts], np.int32)
        flat = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), "<u4")
        row = np.repeat(np.arange(len(self.texts)), self.lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.letters = np.zeros((len(self.texts), max(1, int(self.lengths.max(initial=0)))), np.uint32)
        self.letters[row, place] = flat
        self.counts = np.zeros((_CLASSES, len(self.texts)), np.int16)
        np.add.at(self.counts, (flat % _CLASSES, row), 1)

    def part(self, lo: int, hi: int) -> Names:
        out = object.__new__(Names)
        out.texts, out.lengths, out.letters, out.counts = self.texts[lo:hi], self.lengths[lo:hi], self.letters[lo:hi], self.counts[:, lo:hi]
        return out


class Leaders(Names):
    """Names to compare with: for each letter also the places where it stands, as bits."""

    def __init__(self, texts: Sequence[str]) -> None:
        super().__init__(texts)
        self.alphabet = np.unique(self.letters)
        self.places = np.zeros((len(self.texts), len(self.alphabet) + 1), np.uint64)
        for at in range(min(_WORD, self.letters.shape[1])):
            has = np.flatnonzero(self.lengths > at)
            self.places[has, np.searchsorted(self.alphabet, self.letters[has, at])] |= np.uint64(1 << at)

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Columns of ``places``; the last one, without any bit, for letters that no leader has."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at, len(self.alphabet))


def _one_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def distances(leaders: Leaders, names: Names, leader: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of a leader and a name (by their numbers)."""
    out = np.empty(len(leader), np.int64)
    long = leaders.lengths[leader] > _WORD
    for i in np.flatnonzero(long):
        out[i] = _one_distance(leaders.texts[leader[i]], names.texts[name[i]])
    pairs = np.flatnonzero(~long)
    pairs = pairs[np.argsort(-names.lengths[name[pairs]], kind="stable")]  # those that go on stay in front
    own, length = leader[pairs], names.lengths[name[pairs]]
    codes = leaders.codes(names.letters)
    one = np.uint64(1)
    up, down = np.full(len(pairs), ~np.uint64(0)), np.zeros(len(pairs), np.uint64)
    score = leaders.lengths[own].astype(np.int64)
    last = one << np.maximum(leaders.lengths[own] - 1, 0).astype(np.uint64)
    for at in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -at))  # names of more than ``at`` letters
        equal = leaders.places[own[:n], codes[name[pairs[:n]], at]]
        u, d = up[:n], down[:n]
        diagonal = equal | d
        across = (((equal & u) + u) ^ u) | equal
        rises, falls = d | ~(across | u), u & across
        score[:n] += ((rises & last[:n]) != 0).astype(np.int64) - ((falls & last[:n]) != 0)
        rises, falls = (rises << one) | one, falls << one
        up[:n], down[:n] = falls | ~(diagonal | rises), rises & diagonal
    empty = leaders.lengths[own] == 0
    score[empty] = length[empty]
    out[pairs] = score
    return out


def alike(leaders: Leaders, names: Names, least: int = ALIKE) -> np.ndarray:
    """Whether each name (rows) is alike to each leader (columns): ``least`` to 99 percent, halves rounded up."""
    found = np.zeros((len(names.texts), len(leaders.texts)), bool)
    step = max(1, _TILE // max(1, len(leaders.texts)))
    for lo in range(0, len(names.texts), step):
        part = names.part(lo, lo + step)
        longest = np.maximum(part.lengths[:, None], leaders.lengths[None, :])
        apart = np.abs(part.lengths[:, None] - leaders.lengths[None, :])
        most = np.floor(longest * ((100.5 - least) / 100) + 1e-9).astype(np.int32)
        fits = apart <= most
        if not fits.any():
            continue
        unlike = np.zeros(longest.shape, np.int16)
        for of_name, of_leader in zip(part.counts, leaders.counts, strict=True):
            unlike += np.abs(of_name[:, None] - of_leader[None, :])
        name, leader = np.nonzero(fits & (unlike + apart <= 2 * most))
        if len(name):
            share = (1 - distances(leaders, part, leader, name) / np.maximum(1, longest[name, leader])) * 100 + 0.5
            found[lo + name, leader] = (share >= least) & (share < 100)
    return found


def elected(texts: Sequence[str], at_once: int = 256) -> list[int]:
    """For each name, in order, the number of its leader: the first earlier leader that is alike, or its own."""
    texts = list(texts)
    out = list(range(len(texts)))
    leaders: list[int] = []
    for lo in range(0, len(texts), at_once):
        left = list(range(lo, min(lo + at_once, len(texts))))
        if leaders:
            pairs = alike(Leaders([texts[i] for i in leaders]), Names([texts[i] for i in left]))
            for i, row in zip(left, pairs, strict=True):
                out[i] = leaders[row.argmax()] if row.any() else i
            left = [i for i in left if out[i] == i]
        pairs = alike(Leaders([texts[i] for i in left]), Names([texts[i] for i in left]))
        for n, i in enumerate(left):
            out[i] = next((left[j] for j in np.flatnonzero(pairs[n, :n]).tolist() if out[left[j]] == left[j]), i)
        leaders += [i for i in left if out[i] == i]
    return out


def _elect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        names = pd.concat(parts).sort_values(["row_index", "vendor"], ignore_index=True)
        yield pd.DataFrame({"row_index": names["row_index"], "vendor": names["vendor"], "text": names["text"], "canonical": names["vendor"].iloc[elected(names["text"])].to_numpy()})


NAMES = "row_index long, vendor string, text string, canonical string"


def vendor_renames(invoices: DataFrame, per_round: int = 4096) -> DataFrame:
    """``canonical, alias`` of vendor names (columns ``vendor, row_index``), every name once. Blank and missing names are left out."""
    spark = invoices.sparkSession
    first = invoices.filter(F.trim("vendor") != "").groupBy("vendor").agg(F.min("row_index").cast("long").alias("row_index"))
    text = F.lower(F.regexp_replace("vendor", r"(?U)^\s+|\s+$", ""))
    left = staged(first.select("row_index", "vendor", text.alias("text")), "vendor-names")
    done: list[DataFrame] = []
    while True:
        head = left.orderBy("row_index", "vendor").limit(per_round).coalesce(1)
        head = staged(head.mapInPandas(_elect, NAMES), "vendor-leaders")
        done.append(head.select("canonical", F.col("vendor").alias("alias")))
        # At most ``per_round`` names, and the last of them.
        leaders = head.filter("vendor = canonical").orderBy("row_index", "vendor").select("vendor", "text").collect()
        end = head.orderBy(F.desc("row_index"), F.desc("vendor")).select("row_index", "vendor").first()
        if end is None:
            break
        rest = left.filter((F.col("row_index") > end["row_index"]) | ((F.col("row_index") == end["row_index"]) & (F.col("vendor") > end["vendor"])))
        if rest.isEmpty():
            break
        sent = spark.sparkContext.broadcast([tuple(r) for r in leaders])

        def joined(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = Leaders([t for _, t in sent.value])
            titles = np.array([v for v, _ in sent.value], object)
            for batch in batches:
                pairs = alike(known, Names(batch["text"]))
                own = np.where(pairs.any(axis=1), titles[pairs.argmax(axis=1)], None)
                yield batch.assign(canonical=own)[["row_index", "vendor", "text", "canonical"]]

        judged = staged(rest.mapInPandas(joined, NAMES), "vendor-names")
        done.append(judged.filter("canonical is not null").select("canonical", F.col("vendor").alias("alias")))
        left = judged.filter("canonical is null").drop("canonical")
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out
