"""Whether a label that someone gave a sheet shares any word with the sheet's headers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

# Words that say nothing, and the shortest word that counts.
STOPWORDS = frozenset("the a an of for and or in on at to this that is are sheet tab data workbook table file".split())
SHORTEST_WORD = 3


def words(text: str | None) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= SHORTEST_WORD and w not in STOPWORDS]


def stem(word: str) -> str:
    """Without a plural ending."""
    for ending, longer_than, instead in (("ies", 4, "y"), ("es", 4, ""), ("s", 3, "")):
        if word.endswith(ending) and len(word) > longer_than:
            return word.removesuffix(ending) + instead
    return word


def related(a: str, b: str) -> bool:
    return stem(a) == stem(b) or a in b or b in a


@dataclass(frozen=True)
class Plausibility:
    plausible: bool
    reason: str
    shared: tuple[str, ...]


def plausible_label(label: str, headers: Sequence[str | None]) -> Plausibility:
    """Implausible only if both sides have words and none is shared."""
    own, theirs = words(label), [w for h in headers for w in words(h)]
    if not own or not theirs:
        return Plausibility(True, "not_enough_signal", ())
    shared = tuple(dict.fromkeys(w for w in own if any(related(w, t) for t in theirs)))
    return Plausibility(bool(shared), "shares_vocabulary" if shared else "no_shared_vocabulary", shared)
