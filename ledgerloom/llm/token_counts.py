"""Operator 3: unigram token counts by dynamic programming on a trie of pre-tokens.

Pre-tokens are the words of a text (what stands between white space), each with
the vocabulary's word mark in front.  A pre-token is split into the pieces
whose scores have the greatest sum; of equally good splits the one of fewer
pieces counts.  Splits of a prefix are the same in all pre-tokens that share
it, so distinct pre-tokens are inserted in a trie, and every trie node holds
the best forward score and token count of its prefix, computed once, from its
ancestors.  The node a pre-token ends at is terminal, and its count is kept.

The public vocabulary files hold no unigram probabilities.  A piece's score is
the logarithm of Zipf's law at its rank, ``-log(rank + 3)``.  A character that
no piece covers costs one token for each of its UTF-8 bytes, each with the
score of the last rank.

Every task builds its own trie over its own input rows; when it passes
``max_nodes`` nodes, it starts anew (counts do not depend on it).  Nothing is
shuffled.

Cases: a null or empty text has no tokens; very long words are ordinary paths
of the trie, unless longer than ``longest_in_trie`` characters: those are split
without it; rows with equal ids are counted one by one; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
SCHEMA = "doc_id long, n_words long, n_distinct_words long, n_tokens long"


def piece_scores() -> dict[str, float]:
    """Pieces of the public 32k vocabulary, scored by their rank."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    special = {i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if i not in special]
    return {piece: -math.log(rank + 3) for rank, piece in enumerate(pieces)}


class TrieCounter:
    """Token counts of pre-tokens. Node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float], max_nodes: int = 500_000, longest_in_trie: int = 200) -> None:
        self.scores = scores
        #: All endings of pieces; those that are pieces, with their score (which is below 0).
        self.endings: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(1, len(piece))}
        self.endings.update(scores)
        self.fallback = min(scores.values())
        self.max_nodes, self.longest_in_trie = max_nodes, longest_in_trie
        self._start()

    def _start(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def _forward(self, word: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and token count of ``word[:end]``, from those of all shorter prefixes."""
        last = word[end - 1]
        n_bytes = len(last.encode())
        found = (best[end - 1] + n_bytes * self.fallback, -tokens[end - 1] - n_bytes) if last not in self.scores else None
        endings = self.endings
        for start in range(end - 1, -1, -1):
            score = endings.get(word[start:end], 0)
            if score == 0:  # no piece ends like this, so no longer one does
                break
            if score is not None:
                other = (best[start] + score, -tokens[start] - 1)
                if found is None or other > found:
                    found = other
        return found[0], -found[1]

    def _insert(self, word: str) -> int:
        node, best, tokens = 0, [0.0], [0]
        for depth, char in enumerate(word, 1):
            children = self.children[node]
            if children is None:
                children = self.children[node] = {}
            nxt = children.get(char)
            if nxt is None:
                nxt = children[char] = len(self.best)
                score, count = self._forward(word, depth, best, tokens)
                self.children.append(None)
                self.best.append(score)
                self.tokens.append(count)
            node = nxt
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        return tokens[-1]

    def count(self, word: str) -> int:
        """Tokens of one word."""
        known = self.terminal.get(word)
        if known is None:
            marked = MARK + word
            if len(marked) > self.longest_in_trie:
                return self.without_trie(marked)
            if len(self.best) > self.max_nodes:
                self._start()
            known = self.terminal[word] = self._insert(marked)
        return known

    def without_trie(self, marked: str) -> int:
        best, tokens = [0.0], [0]
        for end in range(1, len(marked) + 1):
            score, count = self._forward(marked, end, best, tokens)
            best.append(score)
            tokens.append(count)
        return tokens[-1]


def token_counts(docs: DataFrame, scores: Callable[[], dict[str, float]] = piece_scores, max_nodes: int = 500_000) -> DataFrame:
    """``doc_id``, words, distinct words and tokens of every row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(scores(), max_nodes)
        for batch in batches:
            rows: list[list[int]] = [[], [], []]
            for text in batch.column(1).cast(pa.binary()):
                occurrences: dict[bytes, int] = {}
                words = (text.as_py() or b"").split()
                for word in words:
                    occurrences[word] = occurrences.get(word, 0) + 1
                rows[0].append(len(words))
                rows[1].append(len(occurrences))
                rows[2].append(sum(n * counter.count(word.decode()) for word, n in occurrences.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows)], ["doc_id", "n_words", "n_distinct_words", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(counted, SCHEMA)
