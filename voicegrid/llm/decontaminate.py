"""Words of documents that also stand in benchmark items, found by Wu-Manber search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from voicegrid.llm import bytewords as B
from voicegrid.llm.common import fresh, stored, text_buffers, with_columns_from_text

WINDOW = 10
BLOCK = 2  # words per block of the shift table
LANE = 256  # starts of windows that one lane of the search covers
BLOCK_BYTES = 8 << 20  # text of benchmark items that one search holds
PIECE_WORDS = 100_000  # windows of one item that one search holds at most
_SLICE = 1 << 18

STATE = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType()),
                                  T.StructField("items", T.ArrayType(T.StringType()))]))


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, begins = text_buffers(column.cast(pa.string()) if pa.types.is_binary(column.type) else column)
    return B.LOWER[raw], begins


class WuManber:
    """Occurrences of windows of ``size`` words each.

    A block is two consecutive words, or one where windows have one word. ``shifts`` tells by how many words
    the search may move on when a window would end with that block: 0 only for blocks that end a window.
    Those are looked up in buckets by the hash of the whole suffix, and then compared word by word. All of
    it lies in flat arrays: the words of the items one behind the other, for each different window its hash
    and the place of one of its occurrences, and the items that own it. Windows of items are told apart by
    their 64-bit hashes; a document's words are compared with a window's as bytes.
    """

    def __init__(self, size: int, words: B.Words, h: np.ndarray, number: np.ndarray, names: list[str]):
        """``words`` are those of the items of this size, with hashes ``h``; ``number`` is the item of each text."""
        self.size, self.block = size, min(BLOCK, size)
        self.names = names
        self.data, self.begins, self.ends = words.data.copy(), words.start, words.end
        at = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
        whole = self._whole(h[at[:, None] + np.arange(size)]) if len(at) < _SLICE else np.concatenate(
            [self._whole(h[at[k:k + _SLICE, None] + np.arange(size)]) for k in range(0, len(at), _SLICE)])
        owner = number[words.doc[at]]
        order = np.lexsort((owner, whole))
        whole, owner, at = whole[order], owner[order], at[order]
        first = np.r_[True, whole[1:] != whole[:-1]]
        once = first | np.r_[True, owner[1:] != owner[:-1]]
        self.buckets, self.places = whole[first], at[first]
        self.owners = owner[once]
        self.owned = np.r_[np.flatnonzero(first[once]), len(self.owners)]
        self.farthest = size - self.block + 1
        keys, shifts = [], []
        inner = at if self.block == 1 else np.unique(np.concatenate([at + k for k in range(size - 1)]))
        if self.block == 1:
            keys, shifts = h[inner], np.zeros(len(inner), np.int64)
        else:
            # The shift of a block is that of its last place in any window: 0 at a window's end, and one more for each word before.
            keys = self._blocks(np.stack([h[inner], h[inner + 1]], 1))
            last = words.first[1:][words.doc[inner]] - 2  # the last block of the text
            ends = np.minimum(inner, last)
            shifts = np.maximum(0, words.first[:-1][words.doc[inner]] + size - 2 - ends)
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        self.keys, self.shifts = keys[first], shifts[first]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.data, self.begins, self.ends, self.buckets, self.places, self.owners, self.owned, self.keys, self.shifts))

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        """A hash of the block in each row."""
        return B.mix(h[:, 0] * np.uint64(0xA0761D6478BD642F) + h[:, 1]) if h.shape[1] == 2 else h[:, 0]

    def _whole(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for k in range(self.size):
            out = out * np.uint64(0xE7037ED1A0B428DB) + h[:, k]
        return B.mix(out)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where windows may start, by hash. All texts are searched at once, in lanes of ``LANE`` starts."""
        starts = [np.arange(a, b - self.size + 1, LANE) for a, b in zip(first[:-1], first[1:], strict=True) if b - a >= self.size]
        if not starts:
            return np.zeros(0, np.int64)
        lasts = np.repeat([b - self.size + 1 for a, b in zip(first[:-1], first[1:], strict=True) if b - a >= self.size],
                          [len(s) for s in starts])
        at = np.concatenate(starts)
        stop = np.minimum(at + LANE, lasts)
        found = []
        while len(at):
            blocks = self._blocks(np.stack([h[at + self.size - self.block + k] for k in range(self.block)], 1))
            place = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
            step = np.where(self.keys[place] == blocks, self.shifts[place], self.farthest)
            hit = at[step == 0]
            if len(hit):
                whole = self._whole(h[hit[:, None] + np.arange(self.size)])
                place = np.minimum(np.searchsorted(self.buckets, whole), len(self.buckets) - 1)
                found.append(hit[self.buckets[place] == whole])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, words: B.Words, h: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """First word and items of every true occurrence, in order."""
        candidates = self.candidates(h, words.first)
        for k in range(0, len(candidates), _SLICE):
            found = candidates[k:k + _SLICE]
            buckets = np.searchsorted(self.buckets, self._whole(h[found[:, None] + np.arange(self.size)]))
            for at, bucket in zip(found.tolist(), buckets.tolist(), strict=True):
                place = int(self.places[bucket])
                if all(words.data[words.start[at + i]:words.end[at + i]].tobytes() == self.data[self.begins[place + i]:self.ends[place + i]].tobytes()
                       for i in range(self.size)):
                    yield at, [self.names[i] for i in self.owners[self.owned[bucket]:self.owned[bucket + 1]]]


def machines_of(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One search for each length of windows in the items ``(id, text)``."""
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    words = B.cut(*_lowered(pa.array([t for _, t in items], pa.string())), B.LETTER_OR_DIGIT)
    sizes = np.minimum(words.counts, window)
    out = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == size)
        some = B.cut(*_lowered(pa.array([items[k][1] for k in mine], pa.string())), B.LETTER_OR_DIGIT)
        out.append(WuManber(size, some, B.hashes(some), np.array([number[items[k][0]] for k in mine]), names))
    return out


def _item_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, number, text``: items cut into pieces of at most ``PIECE_WORDS`` windows, each with all words of its
    windows in lower case. So no window is lost, and no item is too long for one search."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                words = B.cut(*_lowered(pa.array([text.as_py()], pa.string())), B.LETTER_OR_DIGIT)
                n = len(words.start)
                for number, k in enumerate(range(0, max(1, n - window + 1) if n else 0, PIECE_WORDS)):
                    body = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[k:k + PIECE_WORDS + window - 1], words.end[k:k + PIECE_WORDS + window - 1], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([number]), pa.array([body.decode()])], ["item", "number", "text"])

    return items.mapInArrow(work, "item string, number bigint, text string")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns: the number of words, and the runs of hit words with their items.

    Returns the frame and the two columns' names. Texts are read as words of letters, digits and all
    characters beyond ASCII, A-Z in lower case. Items of more than ``limit`` bytes together, long ones cut, are
    searched in several passes; each holds one part of them, its result is stored, and nothing is shuffled. An item with fewer words than
    ``window`` is one window; null and empty texts have no words; an item without words matches nothing.
    """
    words_col, hits_col = fresh(docs, "n_words"), fresh(docs, "hits")
    sc = docs.sparkSession.sparkContext
    out = docs.withColumns({words_col: F.lit(0).cast("bigint"), hits_col: F.lit([]).cast(STATE)})
    pieces = stored(_item_pieces(benchmark, item_id, item_text, window), "benchmark-pieces")
    parts = max(1, -(-(pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit))
    for k in range(parts):
        mine = pieces.filter(F.pmod(F.xxhash64("item", "number"), F.lit(parts)) == k)
        # About ``limit`` bytes of text; the arrays made of it are some ten times that.
        shared = sc.broadcast(machines_of([(r["item"], r["text"]) for r in mine.toLocalIterator()], window))
        if k:
            out = stored(out, "searched")
        inner_words, inner_hits = fresh(out, "found_words"), fresh(out, "found_hits")

        def make(shared=shared):
            machines = shared.value

            def work(column: pa.Array) -> list[pa.Array]:
                words = B.cut(*_lowered(column), B.LETTER_OR_DIGIT)
                h = B.hashes(words)
                runs: dict[int, list] = defaultdict(list)
                for machine in machines:
                    for at, owners in machine.search(words, h):
                        doc = int(words.doc[at])
                        first = at - int(words.first[doc])
                        mine = runs[doc]
                        if mine and first <= mine[-1]["past"] and first >= mine[-1]["first"]:
                            mine[-1]["past"] = max(mine[-1]["past"], first + machine.size)
                            mine[-1]["items"].update(owners)
                        else:
                            mine.append({"first": first, "past": first + machine.size, "items": set(owners)})
                rows = [[x | {"items": sorted(x["items"])} for x in runs.get(d, ())] for d in range(len(column))]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("items", pa.list_(pa.string()))]))
                return [pa.array(words.counts, pa.int64()), pa.array(rows, kind)]

            return work

        found = with_columns_from_text(out, text_col, [T.StructField(inner_words, T.LongType()), T.StructField(inner_hits, STATE)], make)
        out = found.withColumns({words_col: F.col(inner_words), hits_col: F.concat(hits_col, inner_hits)}).drop(inner_words, inner_hits)
    return out, words_col, hits_col


def hit_words(hits: str):
    """The number of words in the union of the runs."""
    spans = F.array_sort(F.transform(hits, lambda r: F.struct(r["first"].alias("first"), r["past"].alias("past"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(spans, start, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["past"] - F.greatest(r["first"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], r["past"]).alias("upto")), lambda s: s["n"])


def items_hit(hits: str):
    """The ids of the items that occur, sorted as strings."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda r: r["items"]))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items`` (sorted ids), ``contaminated`` (any hit)."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(options.get("text_col", "text")))
    out, words, hits = benchmark_hits(kept, benchmark, **options)
    n_hit = hit_words(hits)
    return out.select("doc_id", F.col(words).alias("n_words"), n_hit.alias("n_hit"), items_hit(hits).alias("items"),
                      (F.size(hits) > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with the columns they had."""
    out, _, hits = benchmark_hits(docs, benchmark, **options)
    return out.filter(F.size(hits) == 0).select(docs.columns)
