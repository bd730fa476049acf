"""Runs of words that repeat with a period, and texts with each run cut to its first period.

Suffixes of a text that share their first words form classes. Taken by decreasing length of the shared part
(LCP), neighbours in the suffix array are united with union-find, and each class keeps its positions in order.
Two positions that become neighbours in a class of LCP ``L`` at distance ``d`` seed a stretch of period ``d``
from the first position to the end of the shared part. A run of smallest period ``q`` that begins at ``s`` is
seeded there: between ``s`` and ``s + q`` no position shares as much, or the period would be smaller. All
seeds of a run end at its last word, so the smallest seed of each (period, end) begins the run.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid.llm import bytewords
from voicegrid.llm.common import fresh, text_buffers, with_columns_from_text

LEAST_WORDS = 6
LEAST_EXPONENT = 4
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each k the class of every position by its first 2**k words.

    Prefix doubling: only positions whose class still holds another one are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.r_[True, ids[order][1:] != ids[order][:-1]]
    begins = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(begins, np.diff(np.r_[begins, n]))
    levels = [rank]
    width = 1
    while True:
        alone = np.zeros(n + 1, bool)
        alone[:-1] = np.bincount(rank, minlength=n) == 1
        rows = np.flatnonzero(~alone[rank[order]])  # places in the order that are still open
        if not len(rows) or width >= n:
            return order, levels
        at = order[rows]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        turn = np.argsort(key, kind="stable")
        order[rows] = at = at[turn]  # classes hold consecutive places, so their rows stay within them
        key = key[turn]
        rank = rank.copy()
        rank[at] = rows[np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))]
        levels.append(rank)
        width *= 2


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the next one of the order."""
    n = len(order)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, live = levels[k], np.flatnonzero((a + shared < n) & (b + shared < n))
        same = live[rank[a[live] + shared[live]] == rank[b[live] + shared[live]]]
        shared[same] += 1 << k
    return shared


def seeded_runs(order: np.ndarray, lcp: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` by start and period, found by uniting suffix classes by decreasing LCP."""
    # A run of length n and period q is seeded with an LCP of n - q, at least (exponent - 1) * q and least - q.
    low = max(1, min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1)))
    edges = np.flatnonzero(lcp >= low)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    nodes = np.unique(np.r_[edges, edges + 1])
    left = np.searchsorted(nodes, edges).tolist()
    lengths = lcp[edges].tolist()
    members: list[list[int]] = [[p] for p in order[nodes].tolist()]
    root = list(range(len(nodes)))
    found: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    k, total = 0, len(left)
    while k < total:
        shared, joined = lengths[k], []
        while k < total and lengths[k] == shared:
            x, y = find(left[k]), find(left[k] + 1)
            if len(members[x]) < len(members[y]):
                x, y = y, x
            large, small = members[x], members[y]
            root[y] = x
            if len(small) * 16 < len(large):
                for p in small:
                    insort(large, p)
            else:
                large += small
                large.sort()
            joined.append((x, small))
            k += 1
        # Classes of this LCP are complete only now, so neighbours are looked up now. Those that were
        # neighbours in the smaller class already share more than this and have seeded before.
        for x, small in joined:
            ordered = members[find(x)]
            last = len(ordered) - 1
            for k_own, p in enumerate(small):
                at = bisect_left(ordered, p)
                if at and not (k_own and small[k_own - 1] == ordered[at - 1]):
                    period = p - ordered[at - 1]
                    if period * (exponent - 1) <= shared and period + shared >= least:
                        key = (period, p + shared)
                        found[key] = min(found.get(key, p), p - period)
                if at < last and not (k_own + 1 < len(small) and small[k_own + 1] == ordered[at + 1]):
                    period = ordered[at + 1] - p
                    if period * (exponent - 1) <= shared and period + shared >= least:
                        key = (period, p + period + shared)
                        found[key] = min(found.get(key, p), p)
    return sorted((s, end - s, q) for (q, end), s in found.items())


def text_runs(words: bytewords.Words, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs of several texts as ``(start, length, period)``; starts count the words of all texts.

    Texts in which no sequence of the shortest possible shared part occurs twice are left out first. Word
    hashes are mixed with the number of the text, so nothing matches across texts.
    """
    ids = bytewords.mix(bytewords.hashes(words) + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = max(1, min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1)))
    grams = bytewords.runs(ids, low)
    turn = np.argsort(grams, kind="stable")
    twice = np.flatnonzero(grams[turn][1:] == grams[turn][:-1])
    if not len(twice):
        return []
    busy = np.zeros(len(words.first) - 1, bool)
    busy[words.doc[turn[twice]]] = True
    places = np.flatnonzero(busy[words.doc])
    order, levels = suffix_array(ids[places])
    lcp = neighbour_lcp(order, levels)
    del levels
    return [(int(places[s]), n, q) for s, n, q in seeded_runs(order, lcp, least, exponent)]


def _scan(texts: pa.Array, least: int, exponent: int) -> list[pa.Array]:
    data, begins = text_buffers(texts)
    words = bytewords.cut(data, begins, bytewords.NOT_SPACE)
    found = text_runs(words, least, exponent) if len(words.start) else []
    runs = np.array(found, np.int64).reshape(-1, 3)
    doc = words.doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=len(texts))
    local = runs[:, 0] - words.first[doc] if len(runs) else runs[:, 0]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                                     pa.StructArray.from_arrays([pa.array(local), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN)))
    marks = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(marks)[:-1] == 0
    collapsed = []
    for k, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if text is None:
            collapsed.append(None)
            continue
        parts = text.split()  # at the same six characters
        if counts[k]:
            keep = stays[words.first[k]:words.first[k + 1]].tolist()
            parts = [w for w, stay in zip(parts, keep, strict=True) if stay]
        collapsed.append(b" ".join(parts))
    return [lists, pc.cast(pa.array(collapsed, pa.binary()), pa.string())]


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS,
                  exponent: int = LEAST_EXPONENT) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns, whose names are returned too: the runs, and the text without their repeats.

    Words are what lies between ASCII white space, compared exactly as they are. A run is a stretch with
    smallest period ``q`` and at least ``max(least, exponent * q)`` words that no neighbouring word extends
    (``exponent`` at least 2). Runs are ordered by start and period. The second column joins by one space all
    words but those that some run holds after its first ``q`` words. A null text has no runs and stays null;
    an empty one has none and stays empty. Every row is treated by itself, repeated rows and rows without an
    id included. Texts are read a megabyte at a time, a longer one by itself: it then takes some 100 bytes
    for each word. Words are compared by 64-bit hashes.
    """
    if exponent < 2:
        raise ValueError("exponent must be at least 2")
    runs, collapsed = fresh(docs, "runs"), fresh(docs, "collapsed")
    fields = [T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())]
    return with_columns_from_text(docs, text_col, fields, lambda: lambda texts: _scan(texts, least, exponent)), runs, collapsed


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones that with the smallest start, then period."""
    none = F.lit(None).cast(RUNS.elementType)
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def runs_text(runs: Column) -> Column:
    """One line ``start,length,period`` for each run, each with its line end."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
