"""Helpers shared by the operators: stored results, joins with heavy keys, columns made in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid.session import work_dir

# Bytes of text that one vectorised step holds at once (a longer single text is one step of its own).
STEP_BYTES = 1 << 20
# A key is heavy when it holds at least 1/HEAVY_SHARE of the rows, so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000
# Rows of fixed width that may be broadcast after they have been counted.
BROADCAST_ROWS = 500_000


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: later jobs read the files, whoever is lost."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row per key; ``copies`` counts its rows), safe for heavy keys.

    A counted small table is broadcast. Else the at most ``HEAVY_SHARE`` heaviest keys are broadcast, and
    only rows of other keys are shuffled. Both sides should be stored, because they are read more than once.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    total = rows.count()
    heavy = table.filter(F.col(copies) * HEAVY_SHARE >= total)
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), keys, "left")
    light = marked.filter(F.col("_heavy").isNull()).select(rows.columns).join(table, keys, "left")
    return marked.filter("_heavy").drop("_heavy").unionByName(light)


def text_array(column: pa.Array) -> pa.Array:
    """Texts as large strings without nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array, and where each text begins (with the end as last entry)."""
    column = text_array(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    size = int(begins[-1] - begins[0])
    raw = np.frombuffer(data, np.uint8)[begins[0]:begins[-1]] if size else np.zeros(0, np.uint8)
    return raw, begins - begins[0]


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text, or one row."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow array of byte strings: ``counts`` items of ``data`` each, in order."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    ends *= data.dtype.itemsize
    body = pa.py_buffer(np.ascontiguousarray(data))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), body]).cast(pa.binary())


Maker = Callable[[], Callable[[pa.Array], list[pa.Array]]]


def with_columns_from_text(df: DataFrame, text: str, fields: list[T.StructField], make: Maker) -> DataFrame:
    """``df`` with ``fields`` added, made from the text column in Arrow batches.

    ``make()`` runs once per task and gives the function from a slice of texts to one array per field.
    The new names must not be taken (see ``fresh``).
    """
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in steps(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *fn(part.column(text))], names)

    return df.mapInArrow(work, schema)
