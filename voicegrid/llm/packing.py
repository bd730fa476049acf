"""Packing of token ids into sequences by first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from voicegrid.llm.common import steps, stored
from voicegrid.llm.tokens import STEP_BYTES, WordTokenizer

GROUP_PIECES = 4096
FULL = 1 << 62  # sequence ids from here on are those of full pieces


class CapacityTree:
    """A tournament tree over bins: each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it, and return that bin."""
        node, room = 1, self.room
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        bin_no = node - self.leaves
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return bin_no


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes of ``sizes`` (each at least 1, at most ``capacity``); ties keep their order."""
    tree, bins = CapacityTree(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack_group(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(index, start, length)``, full ones but for lengths that are powers of two.

    After first-fit decreasing, bins are taken from the least filled on, and their documents are cut to
    fill the others' gaps. What is left is less than one bin; it is cut at powers of two.
    """
    bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)]
    filled = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-filled[b], b))
    done: list[list[tuple[int, int, int]]] = []
    giver: list[tuple[int, int, int]] = []
    last = len(order) - 1
    for k, b in enumerate(order):
        if k > last:
            break
        gap = capacity - filled[b]
        while gap and (giver or last > k):
            if not giver:
                giver = list(bins[order[last]])
                last -= 1
            i, start, length = giver.pop()
            used = min(gap, length)
            bins[b].append((i, start, used))
            gap -= used
            if used < length:
                giver.append((i, start + used, length - used))
        if gap:
            giver = bins[b]
        else:
            done.append(bins[b])
    rest = sum(p[2] for p in giver)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        sequence, rest = [], rest - size
        while size:
            i, start, length = giver.pop()
            used = min(size, length)
            sequence.append((i, start, used))
            size -= used
            if used < length:
                giver.append((i, start + used, length - used))
        done.append(sequence)
    return done


def _wide(ids: bytes, n: int) -> np.ndarray:
    """``n`` stored ids, of two or four bytes each, as four-byte ids."""
    return np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<u2").astype("<u4")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``; without the
    last one, and without storing the ids of full pieces, where ``with_ids`` is false.

    A document's ids are those of its text (null and empty: none) and ``end_id``. Each full ``capacity`` of
    them is a sequence by itself, numbered by the task that encodes it; only the rest, shorter than one
    sequence, is moved and packed. The encoded pieces are stored, and the rests are counted: they are dealt
    to random groups of about ``group_pieces`` by a hash of their content and of how many equal ones a task
    has seen, so that repeated rows spread as well and a repeated task deals alike. A group is at most some
    ``group_pieces * capacity`` ids, whatever the length of the documents. Repeated rows are packed each.
    """
    field = T.StructField
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = T.StructType([field("full", T.BooleanType()), field("number", T.LongType()), rows.schema["doc_id"], field("start", T.LongType()),
                          field("doc_tokens", T.LongType()), field("ids_crc32", T.LongType()), field("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordTokenizer(tokenizer), Counter()
        end = np.array([end_id], words.type).tobytes()
        number = FULL + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                at = []
                for row, ids in enumerate(words.encode_all(part.column("text")).to_pylist()):
                    ids += end
                    width = words.type.itemsize
                    n, crc = len(ids) // width, zlib.crc32(ids)
                    seen[crc] += 1
                    for start in range(0, n, capacity):
                        full, piece, sum32 = n - start >= capacity, ids[width * start:width * (start + capacity)], None
                        if full:
                            key, sum32 = number, zlib.crc32(_wide(piece, capacity))
                            piece = piece if with_ids else None
                            number += 1
                        else:
                            key = crc * 0x9E3779B97F4A7C15 + (seen[crc] << 20) + start // capacity
                            key = ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 17
                        for x, v in zip(out, (full, key, start, n, sum32, piece), strict=True):
                            x.append(v)
                        at.append(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int64()), part.column("doc_id").take(pa.array(at, pa.int32())),
                     *(pa.array(x, pa.int64()) for x in out[2:5]), pa.array(out[5], pa.binary())], dealt.names)
        words.close()

    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    packed = T.StructType([rows.schema["doc_id"], *(field(c, T.LongType()) for c in numbers), *([field("ids", T.BinaryType())] if with_ids else [])])

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_wide(b, capacity).tobytes() for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], packed.names)

    def place(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        starts, totals = (table.column(c).to_numpy() for c in ("start", "doc_tokens"))
        blobs = table.column("ids").to_pylist()
        sizes = [int(min(capacity, n - s)) for s, n in zip(starts, totals, strict=True)]
        pieces = []
        for number, sequence in enumerate(pack_group(sizes, capacity)):
            offset = 0
            for i, start, length in sequence:
                ids = _wide(blobs[i], sizes[i])[start:start + length]
                pieces.append((i, int(starts[i]) + start, length, zlib.crc32(ids), int(totals[i]), (group << 32) + number, offset,
                               *([ids.tobytes()] if with_ids else [])))
                offset += length
        columns = list(zip(*pieces, strict=True))
        doc_id = table.column("doc_id").combine_chunks().take(pa.array(columns[0], pa.int32()))
        return pa.table([doc_id, *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.binary()) for c in columns[7:])], packed.names)

    pieces = stored(rows.mapInArrow(encode, dealt), "pieces")
    rests = pieces.filter("NOT full")
    groups = max(1, -(-rests.count() // group_pieces))
    rests = rests.select((F.col("number") % groups).alias("group"), "doc_id", "start", "doc_tokens", "ids")
    alone = pieces.filter("full").select("doc_id", "start", F.lit(capacity).cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
                                         F.col("number").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *(["ids"] if with_ids else []))
    alone = alone.mapInArrow(widened, packed) if with_ids else alone
    return alone.unionByName(rests.groupBy("group").applyInArrow(place, packed))


def packed_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``docs`` cut into pieces, as ``pack`` returns them, without the ids themselves."""
    return pack(docs, tokenizer, **options, with_ids=False)
