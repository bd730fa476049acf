"""Repeated runs of lines, found by winnowing over line hashes and cut from all but the first document.

A window is a run of lines, begun at any line and ended as soon as it has ``least_words`` words, or ended at
any line and begun as late as it can be to have them. Its fingerprint is its line with the smallest hash.
Equal windows have equal fingerprints, so two texts that share a window share one. Only windows whose
fingerprint occurs at two places are looked at further: their whole content is hashed, and every one that has
occurred earlier is cut. Windows of both kinds together cover each repeated run to its first and last line,
so those that repeat join to what extending a match line by line both ways would find: in a run, the lines up
to the end of the window begun at its first line are in that one, and each later line ends a window inside the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from voicegrid.llm import bytewords as B
from voicegrid.llm.common import fresh, lookup, steps, stored, text_buffers

LEAST_WORDS = 40


def line_windows(raw: np.ndarray, begins: np.ndarray, least_words: int) -> dict[str, np.ndarray]:
    """All windows of several texts: ``doc`` and first and last line (``first``, ``last`` within the text),
    the fingerprint's hash and line (``mark``, ``at``), and a hash of the whole content (``content``)."""
    lines = B.cut(raw, begins, B.NOT_LINE_END)
    h = B.hashes(lines)
    words = B.cut(raw, begins, B.NOT_SPACE)
    edges = np.r_[lines.start, len(raw)]
    held = np.diff(np.searchsorted(words.start, edges))  # words of each line; blank lines are no lines
    total = np.r_[0, np.cumsum(held)]
    n = len(h)
    last = np.searchsorted(total, total[:-1] + least_words) - 1  # last line of the window begun at each line
    stop = lines.first[1:][lines.doc] if n else np.zeros(0, np.int64)
    ok = last < stop
    i, j = np.flatnonzero(ok), last[ok]
    # Windows ended at a line where none of those above ends (if one does, the shortest of them is the same window).
    tails = np.setdiff1d(np.arange(n), j)
    heads = np.searchsorted(total, total[tails + 1] - least_words, side="right") - 1  # last line it can begin at
    ok = heads >= lines.first[lines.doc[tails]]
    i, j = np.r_[i, heads[ok]], np.r_[j, tails[ok]]
    at = last_smallest(h, i, j)
    span = j - i
    # The content's hash is a difference of sums over all lines, whatever their number.
    power = B._powers(B._BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    content = (sums[j + 1] - sums[i]) * B._powers(B._INVERSE, n + 1)[i]
    doc = lines.doc[i]
    base = lines.first[doc]
    return {"doc": doc, "first": i - base, "last": j - base, "mark": h[at], "at": at - base,
            "content": B.mix(content + span.astype(np.uint64)), "lines": np.diff(lines.first), "spans": lines}


def last_smallest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the smallest value, the last of equal ones, in each range ``first`` to ``last``.

    Two overlapping stretches of 2**k values cover a range; the stretches of one k are made from those of the one before.
    """
    size = last - first + 1
    level = np.zeros(len(size), np.int64)
    while len(size) and (more := (2 << level) <= size).any():
        level[more] += 1
    out = first.copy()
    best, k = np.arange(len(values)), 0
    while len(best):
        mine = np.flatnonzero(level == k)
        x, y = best[first[mine]], best[last[mine] - (1 << k) + 1]
        out[mine] = np.where(values[y] <= values[x], y, x)
        if k >= level.max(initial=0):
            break
        x, y = best[:-(1 << k)], best[1 << k:]
        best, k = np.where(values[y] <= values[x], y, x), k + 1
    return out


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, runs``: the runs of lines to be cut, by document and 64-bit hash of its text.

    A window repeats when it occurs at an earlier place; places are ordered by id, text hash and line, null
    ids last. Rows equal in id and text are one document. ``runs`` is an array of (first, last) line numbers
    that don't touch each other, counting lines that aren't empty. Documents without runs aren't returned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"),
                       F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in (
        "digest", "mark", "at", "first", "last", "content"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                w = line_windows(*text_buffers(part.column("text")), least_words)
                doc = pa.array(w["doc"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(doc), part.column("digest").take(doc),
                     *(pa.array(w[c].astype(np.uint64).view(np.int64)) for c in ("mark", "at", "first", "last", "content"))], schema.names)

    windows = stored(rows.mapInArrow(work, schema), "windows")
    # A fingerprint is one place, whichever number of windows share it.
    place = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "digest", "at")
    marks = (windows.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("copies"))
             .filter("low != high").select("mark", "copies", F.lit(True).alias("again")))
    near = lookup(windows, stored(marks, "fingerprints"), ["mark"], "copies").filter("again").drop("copies", "again")
    near = stored(near, "near")
    start = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "digest", "first")
    firsts = (near.groupBy("content").agg(F.min(start).alias("earliest"), F.max(start).alias("latest"), F.count(F.lit(1)).alias("copies"))
              .filter("earliest != latest").drop("latest"))
    found = lookup(near, stored(firsts, "repeats"), ["content"], "copies").filter(start > F.col("earliest"))
    spans = found.select("doc_id", "digest", "first", "last").distinct()
    order = Window.partitionBy("doc_id", "digest").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Spans that overlap or touch make one run.
    numbered = spans.withColumn("begins", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("begins").over(order))
    runs = numbered.groupBy("doc_id", "digest", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def without_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id",
                           text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with cut texts, and the names of two added columns: lines cut and words cut.

    A text that lost all its lines is empty; line ends that stood behind cut lines go with them. Null texts
    stay null. Texts are moved once, to be joined with the runs.
    """
    digest, runs = fresh(docs, "text_digest"), fresh(docs, "runs")
    cuts = repeated_lines(docs, least_words, id_col, text_col).withColumnsRenamed({"digest": digest, "runs": runs, "doc_id": "cut_id"})
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    other = cuts.select(F.col("cut_id").alias("_cut_id"), F.col(digest).alias("_cut_digest"), F.col(runs).alias(runs))
    out = marked.join(other, marked[id_col].eqNullSafe(other["_cut_id"]) & (marked[digest] == other["_cut_digest"]), "left")
    n_lines, n_words = fresh(docs, "cut_lines"), fresh(docs, "cut_words")
    out = out.select(*docs.columns, runs)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_words, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_col).to_pylist(), batch.column(runs).to_pylist()
            lines, words = [0] * len(texts), [0] * len(texts)
            for k, found in enumerate(spans):
                if found:
                    texts[k], lines[k], words[k] = cut_lines(texts[k], [(s["first"], s["last"]) for s in found])
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(words, pa.int64())], [*names, n_lines, n_words])

    return out.mapInArrow(work, schema), n_lines, n_words


def cut_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """A text without the given runs, in order, of its lines that aren't empty; how many lines and words went.
    An empty line behind a line that went, and before the next one that isn't empty, goes with it."""
    kept, number, lines, words, at = [], -1, 0, 0, 0
    for line in text.split("\n"):
        number += bool(line)
        while at < len(runs) and runs[at][1] < number:
            at += 1
        if at < len(runs) and runs[at][0] <= number:
            lines += bool(line)
            words += len(line.encode().split())
        else:
            kept.append(line)
    return "\n".join(kept), lines, words
