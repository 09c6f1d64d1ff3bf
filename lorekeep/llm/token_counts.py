"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over marked words.  A node's failure link leads to where matching goes on
when no longer match is possible, and carries the number of pieces that are then complete.  A word
is read once, character by character; no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import answered_id, map_arrow, raw_texts, type_of

MARK = "▁"


class PieceAutomaton:
    """Counts the pieces of greedy longest-match segmentation of a word.

    ``pieces`` starting with the mark begin a word, the others continue one.  A word that cannot
    be covered is one unknown token.
    """

    def __init__(self, pieces: Iterable[str]) -> None:
        # Node 0 begins a word; node 1 goes on within one.
        self.step: list[dict[str, int]] = [{}, {}]
        whole: list[bool] = [False, False]
        for piece in pieces:
            begins = piece.startswith(MARK)
            node = 0 if begins else 1
            letters = piece[1:] if begins else piece
            if begins and not letters:
                continue  # the bare mark is the start itself
            for letter in letters:
                node = self.step[node].setdefault(letter, len(self.step))
                if node == len(whole):
                    self.step.append({})
                    whole.append(False)
            if letters:
                whole[node] = True
        self.failure = np.full(len(whole), -1, np.int64).tolist()
        self.popped = [0] * len(whole)
        queue = [0, 1]
        for node in queue:
            for letter, child in self.step[node].items():
                queue.append(child)
                if whole[child]:
                    self.failure[child], self.popped[child] = 1, 1
                    continue
                at, popped = self.failure[node], self.popped[node]
                while at >= 0 and letter not in self.step[at]:
                    popped += self.popped[at]
                    at = self.failure[at]
                if at >= 0:
                    self.failure[child], self.popped[child] = self.step[at][letter], popped

    def count(self, word: str) -> int:
        """Pieces of ``word``; -1 if it can't be covered; 0 for an empty one."""
        if not word:
            return 0
        step, failure, popped = self.step, self.failure, self.popped
        node = pieces = 0
        for letter in word:
            while (to := step[node].get(letter)) is None:
                if failure[node] < 0:
                    return -1
                pieces += popped[node]
                node = failure[node]
            node = to
        while node != 1:
            if failure[node] < 0:
                return -1
            pieces += popped[node]
            node = failure[node]
        return pieces


class _Counted(dict):
    """Word to count; emptied when it has grown large.  Long words are not kept."""

    def __init__(self, automaton: PieceAutomaton, most: int) -> None:
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def piece_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", cached_words: int = 400_000) -> DataFrame:
    """``id_col, n_words, n_tokens, n_unknown`` for every row.

    Words are runs of anything but ASCII white space; an uncovered word counts as one token and is
    counted in ``n_unknown``.  Null and empty texts have no words.  Ids may be null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sorted(set(pieces)))  # a vocabulary: its size doesn't depend on the data
    id_name = answered_id(id_col, ["n_words", "n_tokens", "n_unknown"])
    schema = f"{id_name} {type_of(docs, id_col)}, n_words bigint, n_tokens bigint, n_unknown bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Counted(PieceAutomaton(shared.value), cached_words)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in raw_texts(batch.column(1)):
                # bytes.split() parts at exactly the six ASCII white-space characters
                found = list(map(counted.__getitem__, text.split()))
                misses = found.count(-1)
                words.append(len(found))
                tokens.append(sum(found) + 2 * misses)
                unknown.append(misses)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=[id_name, "n_words", "n_tokens", "n_unknown"])

    return map_arrow(docs.select(id_col, text_col), work, schema)
