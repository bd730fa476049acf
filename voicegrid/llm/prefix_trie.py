"""The trie of conversation prefixes: one node for each distinct sequence of first turns.

A prefix is known by a 128-bit digest: the sum, modulo 2**64 in two lanes, of a hash of each turn with its
depth. Sums of earlier turns can be added later, so a conversation of any length may spread over many tasks.
Conversations in a range of ids make a shard. In each shard the distinct prefix digests get slots by a
minimal perfect hash (levels of bit arrays), each slot's digest is compared with the one looked up, counts
are scattered into flat arrays by slot, and subtree sums go up through an array of parent slots, the deepest
slots first. A node of several shards adds up: its members are in one shard each, and what counts once for a
node (a leaf, its text) counts in the first shard that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from voicegrid.llm.bytewords import mix
from voicegrid.llm.common import lookup, stored

SHARD_ROWS = 500_000
JOINED_BYTES = 1 << 20
_U = np.uint64
_LANES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: ``slots`` gives 0 .. n - 1, or -1 for any other key.

    Each level sets the bits that only one of the remaining keys hashes to; the other keys go on to the next
    level. A slot is the number of bits set before it. The key of the slot is then compared.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        n = len(first)
        self.levels: list[tuple[np.ndarray, int]] = []  # slot by position or -1, of each level
        left, used = np.arange(n), 0
        slot = np.empty(n, np.int64)
        while len(left):
            size = 2 * len(left) + 1
            at = self._place(first[left], second[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, np.cumsum(alone) - 1 + used, -1)
            self.levels.append((slots, size))
            placed = alone[at]
            slot[left[placed]] = slots[at[placed]]
            used += int(placed.sum())
            left = left[~placed]
        self.first, self.second = np.empty(n, _U), np.empty(n, _U)
        self.first[slot], self.second[slot] = first, second

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = _U((level + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)
        return (mix(first ^ mix(second + salt)) % _U(size)).astype(np.int64)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out, left = np.full(len(first), -1, np.int64), np.arange(len(first))
        for level, (slots, size) in enumerate(self.levels):
            found = slots[self._place(first[left], second[left], level, size)]
            out[left] = found
            left = left[found < 0]
        hit = np.flatnonzero(out >= 0)
        wrong = (self.first[out[hit]] != first[hit]) | (self.second[out[hit]] != second[hit])
        out[hit[wrong]] = -1
        return out


def _term(turns: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What turns (two lanes of 64 bits) at their depths add to the two lanes of a prefix digest."""
    place = depth.astype(_U)
    return tuple(mix(mix(turns[:, k] + place * _LANES[k]) ^ turns[:, 1 - k]) for k in range(2))  # type: ignore[return-value]


_PATH = [("conv", T.LongType()), ("depth", T.LongType()), ("p1", T.LongType()), ("p2", T.LongType()), ("q1", T.LongType()), ("q2", T.LongType()),
         ("chars", T.LongType()), ("part", T.IntegerType()), ("kind", T.IntegerType()), ("before", T.LongType())]
_PATHS = T.StructType([T.StructField(n, t) for n, t in _PATH])
_WHOLE, _OPEN, _END = 0, 1, 2


def _rows(conv, depth, ends, starts, chars, part, kind, before) -> pa.RecordBatch:
    n = len(depth)
    lanes = [pa.array(np.ascontiguousarray(x, _U).view(np.int64)) for x in (*ends, *starts)]
    fill = [pa.array(np.broadcast_to(np.asarray(x), n).astype(np.int64)) for x in (conv, depth, chars, before)]
    same = [pa.array(np.broadcast_to(np.asarray(x), n).astype(np.int32)) for x in (part, kind)]
    return pa.RecordBatch.from_arrays([fill[0], fill[1], *lanes, fill[2], *same, fill[3]], _PATHS.names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path rows of a sorted range. Turns before the first header continue a conversation of an earlier range:
    they stay open, with the number of turns before them in this range. The last row is the state at the end."""
    conv = None  # of the last header
    index, shift, skip, lanes = 0, 0, 0, (_U(0), _U(0))  # turns seen, depth minus number of the turn, turns left out, sums so far
    part, seen = 0, False
    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            ids, kinds = batch.column("conv").to_numpy(), batch.column("kind").to_numpy()
            turns = _lanes_of(batch.column("digest"))
            chars = batch.column("chars").to_numpy()
            heads = np.flatnonzero(kinds == 0)
            cuts = [0, *heads.tolist(), len(ids)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if k:  # a header: the conversation's root and the turns it takes over
                    conv, seen = int(ids[a]), True
                    skip, head = batch.column("skip")[a].as_py(), batch.column("head")[a].as_py()
                    own = np.frombuffer(b"".join(x["digest"] for x in head), "<u8").reshape(-1, 2)
                    index, shift, lanes = 0, len(head) - skip + 1, (_U(0), _U(0))
                    depth = np.arange(len(head) + 1)
                    sums = [np.r_[_U(0), np.cumsum(t)] for t in _term(own, depth[1:])]
                    lanes = tuple(s[-1] for s in sums)
                    starts = [np.r_[_U(0), s[:-1]] for s in sums]
                    yield _rows(conv, depth, sums, starts, np.r_[0, [x["chars"] for x in head]], part, _WHOLE, 0)
                    a += 1
                if a >= b:
                    continue
                count = np.arange(b - a) + index
                index += b - a
                if not seen:
                    conv = int(ids[a])
                    yield _rows(conv, count, (turns[a:b, 0], turns[a:b, 1]), (turns[a:b, 0], turns[a:b, 1]), chars[a:b], part, _OPEN, count)
                    continue
                own = np.flatnonzero(count >= skip)
                if len(own):
                    depth = count[own] + shift
                    sums = [s + np.cumsum(t) for s, t in zip(lanes, _term(turns[a:b][own], depth), strict=True)]
                    starts = [np.r_[s, t[:-1]] for s, t in zip(lanes, sums, strict=True)]
                    lanes = tuple(s[-1] for s in sums)
                    yield _rows(conv, depth, sums, starts, chars[a:b][own], part, _WHOLE, 0)
        if conv is not None:
            last = [np.array([x]) for x in lanes]
            yield _rows(conv, np.array([index]), last, last, int(seen), part, _END, shift)


def _lanes_of(column: pa.Array) -> np.ndarray:
    """16-byte digests as two lanes; null as zeros."""
    column = column.fill_null(b"\0" * 16)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


class _Carried:
    """Range ``part`` goes on with conversation ``conv`` of the range ``begun`` before it: the turns and sums up to
    there, and the number of turns ``held`` by this range before another conversation begins."""

    def __init__(self, part: int, conv: int, begun: int, index: int, shift: int, lanes: tuple[int, int] | None, held: int):
        self.part, self.conv, self.begun, self.index, self.shift, self.lanes, self.held = part, conv, begun, index, shift, lanes, held


def _carried(paths: DataFrame) -> list[_Carried]:
    """One entry for each range that begins inside a conversation: a row per range comes to the driver."""
    ends = sorted(paths.filter(F.col("kind") == _END).collect(), key=lambda r: r.part)
    opened = {r.part: r.conv for r in paths.filter(F.col("kind") == _OPEN).groupBy("part").agg(F.first("conv").alias("conv")).collect()}
    out: list[_Carried] = []
    last = None  # the end of the range before; an entry of ``out`` if that range held nothing else
    for r in ends:
        entry = None
        if r.part in opened:
            if isinstance(last, _Carried):
                entry = _Carried(r.part, last.conv, last.part, last.index + last.held, last.shift, None, r.depth)
            else:
                entry = _Carried(r.part, last.conv, last.part, last.depth, last.before, (last.p1 % (1 << 64), last.p2 % (1 << 64)), r.depth)
            out.append(entry)
        last = r if r.chars else entry
    return out


def _terms_of(table: pa.Table, c: _Carried, skip: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    turn = np.argsort(table.column("before").to_numpy())
    count = table.column("before").to_numpy()[turn] + c.index
    turn, count = turn[count >= skip], count[count >= skip]
    digests = np.stack([table.column(x).to_numpy()[turn].view(_U) for x in ("p1", "p2")], axis=1)
    return turn, count + c.shift, list(_term(digests, count + c.shift))


def _complete(paths: DataFrame, taken: DataFrame) -> tuple[DataFrame, list[_Carried]]:
    """All path rows, those of conversations over several ranges included."""
    carried = _carried(paths)
    whole = paths.filter(F.col("kind") == _WHOLE)
    if not carried:
        return whole, carried
    skips = {r.conv: r.skip for r in taken.filter(F.col("conv").isin(sorted({c.conv for c in carried}))).select("conv", "skip").collect()}
    opened = paths.filter(F.col("kind") == _OPEN)
    at = {c.part: c for c in carried}
    known = {c.part: c.begun for c in carried if c.lanes is None}  # needs the sums of the range before
    if known:
        def total(table: pa.Table) -> pa.Table:
            c = at[table.column("part")[0].as_py()]
            sums = [int(t.sum()) for t in _terms_of(table, c, skips[c.conv])[2]]
            return pa.table({"part": [c.part], "s1": pa.array(np.array([sums[0]], _U).view(np.int64)), "s2": pa.array(np.array([sums[1]], _U).view(np.int64))})

        before = opened.filter(F.col("part").isin(sorted(set(known.values())))).groupBy("part").applyInArrow(total, "part bigint, s1 bigint, s2 bigint")
        sums = {r.part: (r.s1, r.s2) for r in before.collect()}
        for c in carried:  # in ascending order, so the entry before is complete
            if c.lanes is None:
                c.lanes = tuple((x + y) % (1 << 64) for x, y in zip(at[c.begun].lanes, sums[c.begun], strict=True))

    def follow(table: pa.Table) -> pa.Table:
        c = at[table.column("part")[0].as_py()]
        with np.errstate(over="ignore"):
            turn, depth, terms = _terms_of(table, c, skips[c.conv])
            ends = [_U(x) + np.cumsum(t) for x, t in zip(c.lanes, terms, strict=True)]
        starts = [np.r_[_U(x), e[:-1]] if len(e) else e for x, e in zip(c.lanes, ends, strict=True)]
        return pa.Table.from_batches([_rows(c.conv, depth, ends, starts, table.column("chars").to_numpy()[turn], c.part, _WHOLE, 0)])

    return stored(whole.unionByName(opened.groupBy("part").applyInArrow(follow, _PATHS)), "all-paths"), carried


def _local_nodes(table: pa.Table) -> pa.Table:
    """The distinct prefixes of a shard with their members in it."""
    p1, p2 = (table.column(x).to_numpy().view(_U) for x in ("p1", "p2"))
    order = np.lexsort((p2, p1))
    new = np.r_[True, (p1[order][1:] != p1[order][:-1]) | (p2[order][1:] != p2[order][:-1])]
    one = order[new]
    slots = SlotTable(p1[one], p2[one])
    slot = slots.slots(p1, p2)
    conv = table.column("conv").to_numpy()
    members = np.bincount(slot, minlength=len(one))
    low = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(low, slot, conv)
    at = slot[one]
    columns = {x: table.column(x).to_numpy()[one] for x in ("p1", "p2", "q1", "q2", "depth", "chars", "part")}
    return pa.table({**columns, "members": members[at], "low": low[at]}).cast(_NODES)


_NODES = pa.schema([(n, pa.int32() if n == "part" else pa.int64()) for n in ("p1", "p2", "q1", "q2", "depth", "chars", "part", "members", "low")])
_NODE_TYPES = "p1 bigint, p2 bigint, q1 bigint, q2 bigint, depth bigint, chars bigint, part int, members bigint, low bigint"
_SUMS = "p1 bigint, p2 bigint, leaves bigint, member_chars bigint, node_chars bigint, part int, parentless boolean"


def _subtree_sums(table: pa.Table) -> pa.Table:
    """Leaves and code points below each node of a shard, itself included."""
    p1, p2, q1, q2 = (table.column(x).to_numpy().view(_U) for x in ("p1", "p2", "q1", "q2"))
    depth = table.column("depth").to_numpy()
    slots = SlotTable(p1, p2)
    at = slots.slots(p1, p2)
    n = len(at)
    values = np.zeros((n, 3), np.int64)
    for k, name in enumerate(("leaf", "member_chars", "node_chars")):
        values[at, k] = table.column(name).to_numpy()
    parent, height = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    inner = np.flatnonzero(depth > 0)
    parent[at[inner]] = slots.slots(q1[inner], q2[inner])
    height[at] = depth
    order = np.argsort(-height, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, height[order][1:] != height[order][:-1]]), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # the deepest slots first
        level = order[a:b]
        level = level[parent[level] >= 0]
        np.add.at(values, parent[level], values[level])
    lone = (parent[at] < 0) & (depth > 0)
    return pa.table({"p1": table.column("p1"), "p2": table.column("p2"), **{x: values[at, k] for k, x in enumerate(("leaves", "member_chars", "node_chars"))},
                     "part": table.column("part"), "parentless": lone})


def _member_hashes(ends: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256``: the ids of each prefix's complete conversations, ascending, joined by commas, hashed.

    Ids are sorted in ranges, so that a prefix with very many spreads; each range joins a prefix's ids to
    texts of about a megabyte, and these are hashed one after the other, never put together.
    """
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = "p1 bigint, p2 bigint, part int, number bigint, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size, number, part = None, [], 0, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([part], pa.int32()),
                                               pa.array([number], pa.int64()), pa.array([",".join(held)])], ["p1", "p2", "part", "number", "ids"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for a, b, conv in zip(*(batch.column(x).to_pylist() for x in ("p1", "p2", "conv")), strict=True):
                if (a, b) != last or size > JOINED_BYTES:
                    if held:
                        yield out()
                    last, held, size, number = (a, b), [], 0, number + 1
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("p1", "p2", "ids")), strict=True):
                if (a, b) == last:
                    state.update(b"," + ids.encode())
                    continue
                if last:
                    done.append((*last, state.hexdigest()))
                last, state = (a, b), hashlib.sha256(ids.encode())
            yield table(done)
            done = []
        if last:
            yield table([(*last, state.hexdigest())])

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["p1", "p2", "ends_sha256"])

    ranges = ends.repartitionByRange(parts, "p1", "p2", "conv").sortWithinPartitions("p1", "p2", "conv").withColumn("part", F.spark_partition_id())
    joined = ranges.mapInArrow(join, texts)
    return joined.repartition(parts, "p1", "p2").sortWithinPartitions("p1", "p2", "part", "number").mapInArrow(digest, "p1 bigint, p2 bigint, ends_sha256 string")


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, digest, chars``: rows of fixed width in place of texts. Turns without a conversation id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    kept = turns.filter(F.col(conv_col).isNotNull())
    return kept.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("chars"))


def first_turns(digests: DataFrame, n: int) -> DataFrame:
    """``conv, head``: the first ``n`` turns of each conversation, in order. Tasks cut to ``n`` before anything moves."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    first = digests.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= n)
    heads = first.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("number", "digest", "chars"))).alias("head"))
    return heads.withColumn("head", F.transform("head", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))))


def prefix_trie(digests: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``digests`` has the turns, as ``turn_digests`` gives them. Turns are ordered by ``turn`` (null first, equal
    ones by digest); repeated rows are turns of their own. ``taken`` may name for each conversation (``conv``
    once each, those without turns too) a number ``skip`` of first turns that it leaves out and turns
    ``head`` (at most some) that stand before the others. A node's ``conv_id`` is the smallest of its members.
    An empty table has no conversations, hence no node.
    """
    spark = digests.sparkSession
    turns = stored(digests, "turns")
    if taken is None:
        head_type = T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("chars", T.LongType())]))
        taken = turns.select("conv").distinct().withColumns({"skip": F.lit(0), "head": F.array().cast(head_type)})
    taken = stored(taken.select("conv", F.col("skip").cast("int").alias("skip"), F.coalesce("head", F.array().cast(taken.schema["head"].dataType)).alias("head")), "heads")
    headers = taken.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("digest"),
                           F.lit(0).cast("bigint").alias("chars"), "skip", "head", F.lit(0).cast("bigint").alias("same"))
    rows = headers.unionByName(turns.select("conv", F.lit(1).alias("kind"), "turn", "digest", "chars", F.lit(None).cast("int").alias("skip"),
                                            F.lit(None).cast(taken.schema["head"].dataType).alias("head"), F.monotonically_increasing_id().alias("same")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // SHARD_ROWS))
    keys = ["conv", "kind", F.col("turn").asc_nulls_first(), "digest", "same"]
    ranges = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).drop("turn", "same")
    walked = stored(ranges.mapInArrow(_walk, _PATHS), "paths")
    paths, carried = _complete(walked, taken)
    local = stored(paths.groupBy("part").applyInArrow(_local_nodes, _NODE_TYPES), "local-nodes")
    key = ["p1", "p2"]
    nodes = local.groupBy(key).agg(F.sum("members").alias("n_convs"), F.min("low").alias("conv_id"), F.min("part").alias("owner"),
                                   *[F.first(c).alias(c) for c in ("q1", "q2", "depth", "chars")])
    nodes = stored(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "nodes")
    owned = F.col("part") == F.col("owner")
    shards = local.join(nodes.select(*key, "owner", "n_children"), key).select(
        *key, "q1", "q2", "depth", "part", (F.col("members") * F.col("chars")).alias("member_chars"),
        F.when(owned, F.col("chars")).otherwise(F.lit(0)).alias("node_chars"),
        (owned & (F.col("n_children") == 0)).cast("bigint").alias("leaf"))
    sums = shards.groupBy("part").applyInArrow(_subtree_sums, _SUMS)
    names = ["leaves", "member_chars", "node_chars"]
    if carried:
        sums = stored(sums, "subtree-sums")
        missing = {r.part: [r[n] for n in names] for r in sums.filter("parentless").collect()}  # at most one per range
        added, later = [], {}
        for c in reversed(carried):  # what the later ranges of a conversation hold, for each earlier one
            held = later.get(c.conv, [0, 0, 0])
            later[c.conv] = held = [x + y for x, y in zip(held, missing.get(c.part, [0, 0, 0]), strict=True)]
            added.append((c.conv, c.begun, *held))
        more = spark.createDataFrame(added, "conv bigint, part int, leaves bigint, member_chars bigint, node_chars bigint")
        sums = sums.unionByName(paths.select("conv", "part", *key).join(F.broadcast(more), ["conv", "part"]).drop("conv", "part"), allowMissingColumns=True)
    sums = sums.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    ends = paths.groupBy("conv").agg(F.max(F.struct("depth", *key)).alias("end")).select("conv", "end.p1", "end.p2")
    parent = nodes.filter("n_children > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = lookup(nodes.filter("depth > 0").drop("n_children"), parent.withColumnRenamed("n_children", "copies"), ["q1", "q2"], "copies")
    parents = found.select(*key, "parent_conv_id")
    out = nodes.join(sums, key).join(parents, key, "left").join(_member_hashes(ends), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      (F.col("member_chars") - F.col("node_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
