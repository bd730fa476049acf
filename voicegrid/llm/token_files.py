"""Token ids of documents as ORC files in document order.

ORC keeps the ids of a stripe as run-length encoded integers, with minimum, maximum and a Bloom filter of
``doc_id`` for each stripe and row group. Readers split files at stripes; a filter on ``doc_id`` skips
stripes and row groups by this metadata.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voicegrid.llm.common import BROADCAST_ROWS, steps
from voicegrid.llm.tokens import STEP_BYTES, WordTokenizer

STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 1000
SAMPLED_PER_PART = 100


def _range_bounds(docs: DataFrame, id_col: str, parts: int) -> tuple[list, int]:
    """At most ``parts - 1`` ids that cut the ids into ranges of about equal rows, ascending, and how many
    ranges rows without an id take. They come from a sample of some ``SAMPLED_PER_PART`` ids per range."""
    ids = docs.select(id_col)
    share = min(1.0, parts * SAMPLED_PER_PART / max(1, ids.count()))
    found = [r[0] for r in (ids.sample(share, seed=1) if share < 1 else ids).collect()]
    some = sorted(x for x in found if x is not None)
    empty = round(parts * (1 - len(some) / len(found))) if found else 0
    empty = min(parts - 1, max(empty, int(len(some) < len(found))))
    return [some[len(some) * k // (parts - empty)] for k in range(1, parts - empty)] if some else [], empty


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write ``doc_id, part, begin, n_tokens, ids`` in ORC.

    Files follow each other in ascending ``doc_id`` (null first; repeated ids in the order of a text hash),
    as do rows within a file. ``begin`` counts the ids before a document within its part; ``read_documents``
    adds those of earlier parts. Null and empty texts get the end id alone. Texts are encoded where they are
    read, and only their ids are moved, to ranges of ``doc_id`` known beforehand. An id that fills ranges of
    its own, or rows without one, are dealt to those ranges by the text hash.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, empty = _range_bounds(docs, id_col, parts)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    field = T.StructField
    moved = T.StructType([rows.schema["doc_id"], field("digest", T.LongType()), field("part", T.IntegerType()), field("ids", T.BinaryType())])
    ids_type = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([rows.schema["doc_id"], field("part", T.IntegerType()), field("begin", T.LongType()),
                           field("n_tokens", T.LongType()), field("ids", ids_type)])

    def place(doc_id, digest: int) -> int:
        low, high = (0, max(0, empty - 1)) if doc_id is None else (empty + bisect_left(bounds, doc_id), empty + bisect_right(bounds, doc_id))
        return low + (high - low + 1) * (digest + (1 << 63)) // (1 << 64) if high > low else low

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        end = np.array([end_id], words.type).tobytes()
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                at = [place(i, d) for i, d in zip(part.column("doc_id").to_pylist(), part.column("digest").to_pylist(), strict=True)]
                ids = [x + end for x in words.encode_all(part.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(at, pa.int32()), pa.array(ids, pa.binary())], moved.names)
        words.close()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, before = WordTokenizer(tokenizer).type, 0
        for batch in batches:
            found = batch.column("ids").to_pylist()
            sizes = np.array([len(x) // kind.itemsize for x in found], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(found), kind).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(before + ends - sizes), pa.array(sizes), ids], schema.names)
            before += int(ends[-1]) if len(ends) else 0

    ordered = rows.mapInArrow(encode, moved).repartitionById(parts, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest")
    (ordered.mapInArrow(number, schema).write
     .option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROWS_PER_INDEX)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").orc(path))


def read_documents(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the files; only the named documents where ``ids`` is given.

    The offsets of the parts come from a sum per part: one row for each part, whatever the table holds.
    """
    rows = spark.read.orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("held")).collect()
    assert len(sums) <= BROADCAST_ROWS
    before, offsets = 0, []
    for r in sorted(sums, key=lambda r: r["part"]):
        offsets.append((r["part"], before))
        before += r["held"]
    table = F.broadcast(spark.createDataFrame(offsets, "part int, before bigint"))
    if ids is not None:
        rows = rows.filter(F.col("doc_id").isin(ids))
    return rows.join(table, "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids")


def with_checksums(documents: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    kept = documents.select("doc_id", "start", "n_tokens", "ids")
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields[:3], T.StructField("ids_crc32", T.LongType())]))
