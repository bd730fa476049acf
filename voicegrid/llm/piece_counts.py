"""Word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie with failure links. The link of a node leads to where the search goes on once the
longest pieces of the node's text are cut off, and a number tells how many pieces those are. So a word's
greedy length is a sum over its bytes, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voicegrid.llm.common import with_columns_from_text

KEPT_WORDS = 500_000


class PieceCounter:
    """Greedy longest-match counts over ``first`` pieces (at a word's start) and ``inner`` pieces (after it)."""

    ROOT, INNER = 0, 1

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((self.ROOT, first), (self.INNER, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = self.next[node][byte]
                final[node] = node > 1
        self.fail: list[int] = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        self._link(final)

    def _link(self, final: list[bool]) -> None:
        """Links and counts, breadth first. A node that is a piece pops itself; any other one follows its
        parent's link until the last byte can be added, and pops what those links pop."""
        level = [self.ROOT, self.INNER]
        while level:
            below = []
            for node in level:
                for byte, child in self.next[node].items():
                    below.append(child)
                    if final[child]:
                        self.fail[child], self.popped[child] = self.INNER, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if the greedy cut meets bytes that no piece covers. Empty words have none."""
        at, pieces = self.ROOT, 0
        steps, fail, popped = self.next, self.fail, self.popped
        for byte in word:
            while byte not in steps[at]:
                pieces += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = steps[at][byte]
        while at > 1:
            pieces += popped[at]
            at = fail[at]
        return pieces if at == self.INNER or not word else -1


def pieces_of_file(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-piece vocabulary of a public byte-level file: pieces with the mark of a blank begin a word, the
    others stand inside. Single bytes may begin a word too, so that every word has pieces."""
    from voicegrid.llm.tokens import BYTE_CHARACTERS
    byte_of = {c: b for b, c in BYTE_CHARACTERS.items()}
    blank = BYTE_CHARACTERS[32]
    vocabulary = json.load(open(path))["model"]["vocab"]
    as_bytes = [bytes(map(byte_of.__getitem__, v)) for v in vocabulary if all(c in byte_of for c in v)]
    first = [p[1:] for p in as_bytes if len(p) > 1 and p[0] == 32] + [bytes([b]) for b in range(256)]
    inner = [p for p in as_bytes if p[0] != byte_of[blank]] + [bytes([b]) for b in range(256)]
    return first, inner


class _Kept(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        n = self.count(word)
        self[word] = n = 1 if n < 0 else n
        return n


def piece_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` per row: words between ASCII white space and their greedy word pieces.

    A word that pieces don't cover counts as one token (unknown). Null and empty texts have none of either.
    Rows are independent: repeated rows count alike, extra columns are ignored, and nothing is shuffled.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        counts = _Kept(PieceCounter(*pieces_of_file(vocabulary)).count)

        def work(column: pa.Array) -> list[pa.Array]:
            words = [t.split() if t else () for t in column.cast(pa.binary()).to_pylist()]
            return [pa.array(np.array([len(w) for w in words], np.int64)),
                    pa.array(np.array([sum(map(counts.__getitem__, w)) for w in words], np.int64))]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return with_columns_from_text(kept, "text", fields, make).drop("text")
