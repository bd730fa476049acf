"""Near duplicates by word n-gram Jaccard similarity: an exact set join with rare-first prefix filtering.

1. Every text becomes a set of hashed word n-grams. Texts with equal sets are one class, named by a 128-bit
   digest of the set, so copies never meet each other.
2. N-grams of all classes are counted. Those of a single class can't be shared and are only counted; a class
   whose prefix holds nothing else has no partner and leaves here. The rest keep their shared n-grams in the
   order (count, hash), rarest first.
3. Classes whose prefixes share an n-gram are candidates if length, position and suffix filters let them
   pass. First every class meets the best representative of each of its prefix n-grams, so a large group is
   linked by about as many pairs as it has members. Then only pairs that aren't connected yet are compared.
   Each pair is verified once, by intersecting the n-grams that both share with anyone.
4. Links are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voicegrid.llm import bytewords as B
from voicegrid.llm.common import BROADCAST_ROWS, binaries, fresh, lookup, steps, stored, text_buffers

PERCENT = 80
NGRAM = 5
FLUSH = 1_000_000  # n-grams that a task holds before it passes them on
HOT_SHARE = 200  # an n-gram in over 1/HOT_SHARE of all rows is counted apart
WORDS = 8  # 64-bit words of the suffix filter: as many bits as parts of the n-gram hashes
ROUNDS = 3  # rounds with representatives before the pairs that are left are compared

_U = np.uint64


def ngram_sets(column: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The sets of several texts: all distinct n-gram hashes, ascending within a text, and where each text begins.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text with fewer than ``n`` words
    has one n-gram, its whole sequence of words; without words it has none.
    """
    raw, begins = text_buffers(column)
    words = B.cut(B.LOWER[raw], begins, B.NOT_SPACE)
    h = B.hashes(words)
    counts = words.counts
    grams, docs = B.runs(h, n), np.zeros(0, np.int64)
    if len(grams):
        same = words.doc[:len(grams)] == words.doc[n - 1:]
        grams, docs = grams[same], words.doc[:len(grams)][same]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        whole = [B.mix(B.runs(h[words.first[d]:words.first[d + 1]], int(counts[d])) + _U(counts[d])) for d in few]
        grams, docs = np.r_[grams, np.concatenate(whole)], np.r_[docs, few]
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    if len(grams):
        new = np.r_[True, (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])]
        grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(len(column) + 1))


def set_digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set: two sums of differently mixed hashes, mixed with the size. Empty sets have zeros."""
    out = np.zeros((len(first) - 1, 2), _U)
    size = np.diff(first)
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        sums = np.r_[_U(0), np.cumsum(B.mix(grams + _U(salt)))]
        out[:, k] = np.where(size > 0, B.mix(sums[first[1:]] - sums[first[:-1]] + size.astype(_U) * _U(salt | 1)), 0)
    return out.view(np.uint8).reshape(-1, 16)


def _digest_array(digests: np.ndarray) -> pa.Array:
    return binaries(digests.reshape(-1), np.full(len(digests), 16))


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """All columns but the text, and ``n, class``, of every document, and (``gram, seen``) of n-grams frequent in some task."""
    carried = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in carried), T.StructField("n", T.LongType()), T.StructField("class", T.BinaryType()),
                           T.StructField("gram", T.LongType()), T.StructField("seen", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, classes, met = [], 0, 0, set()

        def frequent() -> pa.RecordBatch:
            grams, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= max(8, classes // HOT_SHARE)
            k = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(k, t) for t in types), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                 pa.array(grams[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], schema.names)

        for batch in batches:
            types = [batch.column(f.name).type for f in carried]
            for part in steps(batch, text):
                grams, first = ngram_sets(part.column(text))
                digests = set_digests(grams, first)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in carried), pa.array(n), _digest_array(digests),
                     pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], schema.names)
                for d, name in enumerate(digests):
                    if n[d] and (key := name.tobytes()) not in met:
                        met.add(key)
                        held.append(grams[first[d]:first[d + 1]])
                        size, classes = size + int(n[d]), classes + 1
                if size > FLUSH:
                    yield frequent()
                    held, size, classes, met = [], 0, 0, set()
        if held:
            yield frequent()

    return docs.mapInArrow(work, schema)


def _gram_rows(docs: DataFrame, text: str, hot: np.ndarray, parts: int) -> DataFrame:
    """N-grams dealt to ``parts`` by hash: ``part, hot, class, n, count, grams`` with one class after the other.

    N-grams known to be hot go to a part by class, so that none of them meets in one task.
    """
    schema = "part int, hot boolean, classes binary, sizes binary, counts binary, grams binary"
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, met = [], [], 0, set()

        def dealt() -> pa.RecordBatch:
            lengths = np.array([len(g) for g in held], np.int64)
            grams, of = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
            apart = np.isin(grams, shared.value)
            bucket = (grams >> _U(33)) % _U(parts)
            by_class = np.array([int.from_bytes(x[:6], "little") % parts for x in names], _U)
            bucket = np.where(apart, by_class[of] + _U(parts), bucket).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            grams, of, bucket = grams[order], of[order], bucket[order]
            rows = []
            digests = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 16)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(edges, np.r_[edges[1:], len(bucket)], strict=True):
                mine = of[a:b]
                new = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                rows.append((int(bucket[a]) % parts, bool(bucket[a] >= parts), digests[mine[new]].tobytes(),
                             lengths[mine[new]].astype(np.uint32).tobytes(),
                             np.diff(np.r_[new, len(mine)]).astype(np.uint32).tobytes(), grams[a:b].tobytes()))
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              ["part", "hot", "classes", "sizes", "counts", "grams"])

        for batch in batches:
            for part in steps(batch, text):
                grams, first = ngram_sets(part.column(text))
                for d, name in enumerate(set_digests(grams, first)):
                    if first[d + 1] > first[d] and (key := name.tobytes()) not in met:
                        met.add(key)
                        names.append(key)
                        held.append(grams[first[d]:first[d + 1]])
                        size += len(held[-1])
                if size > FLUSH:
                    yield dealt()
                    names, held, size, met = [], [], 0, set()
        if held:
            yield dealt()

    return docs.select(text).mapInArrow(work, schema)


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries that name classes: a number for each different class, and an entry of each number's class."""
    halves = np.ascontiguousarray(names).view(_U).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.r_[True, (halves[order][1:] != halves[order][:-1]).any(1)] if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _columns(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in kinds.items()]


_NAME = np.dtype("V16")


def _shared_grams(rows: DataFrame, hot: dict[int, int], parts: int) -> DataFrame:
    """``part, classes, sizes, counts, grams, seen``: the n-grams that more than one class has, dealt to
    ``parts`` by class; one row for each pair of parts."""
    known = rows.sparkSession.sparkContext.broadcast(hot)

    def work(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for is_hot in (False, True):
            mine = table.filter(pc.equal(table.column("hot"), is_hot))
            if not mine.num_rows:
                continue
            names, sizes, counts, grams = _columns(mine, {"classes": _NAME, "sizes": np.uint32, "counts": np.uint32, "grams": _U})
            number, entry = _numbered(names)
            of = np.repeat(number, counts)
            order = np.lexsort((of, grams))
            grams, of = grams[order], of[order]
            keep = np.r_[True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])]
            grams, of = grams[keep], of[keep]
            if is_hot:
                seen = np.array([known.value[g] for g in grams.view(np.int64).tolist()], np.int64)
            else:
                edges = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                seen = np.repeat(times := np.diff(np.r_[edges, len(grams)]), times)
                grams, of, seen = grams[seen > 1], of[seen > 1], seen[seen > 1]
            part = names[entry].view(_U).reshape(-1, 2)[:, 1] % _U(parts)
            order = np.lexsort((of, part[of]))
            grams, of, seen = grams[order], of[order], np.minimum(seen[order], (1 << 32) - 1).astype(np.uint32)
            new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            each, ends = of[new], np.r_[new, len(of)]
            for p in np.unique(part[each]):
                k = np.flatnonzero(part[each] == p)
                low, high = ends[k[0]], ends[k[-1] + 1]
                at = entry[each[k]]
                out.append((int(p), names[at].tobytes(), sizes[at].tobytes(), np.diff(ends)[k].astype(np.uint32).tobytes(),
                            grams[low:high].tobytes(), seen[low:high].tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.binary()] * 5), strict=True)],
                        ["part", "classes", "sizes", "counts", "grams", "seen"])

    schema = "part int, classes binary, sizes binary, counts binary, grams binary, seen binary"
    return rows.groupBy("part").applyInArrow(work, schema)


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection at which sets of these sizes link: 100 i >= percent (n + m - i)."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _candidates_of_class(shared: DataFrame, percent: int) -> DataFrame:
    """``class, n, alone, grams, parity``: classes with shared n-grams in their prefix; all their shared
    n-grams, rarest first, and for each part of the hashes whether it holds an odd number of them."""
    schema = "class binary, n bigint, alone bigint, grams binary, parity array<bigint>"

    def work(table: pa.Table) -> pa.Table:
        names, sizes, counts, grams, seen = _columns(
            table, {"classes": _NAME, "sizes": np.uint32, "counts": np.uint32, "grams": _U, "seen": np.uint32})
        number, entry = _numbered(names)
        of = np.repeat(number, counts)
        order = np.lexsort((grams, seen, of))
        grams, of = grams[order], of[order]
        keep = np.r_[True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])]  # a hot one may come from several tasks
        grams, of = grams[keep], of[keep]
        n, shared = sizes[entry].astype(np.int64), np.bincount(of, minlength=len(entry))
        stay = n - shared < n - -(-percent * n // 100) + 1
        grams, of = grams[stay[of]], of[stay[of]]
        entry, n, shared = entry[stay], n[stay], shared[stay]
        first = np.cumsum(shared) - shared
        bit = (grams >> _U(40)) % _U(64 * WORDS)
        parity = np.zeros((len(n), WORDS), _U)
        for w in range(WORDS if len(n) else 0):
            mine = np.where(bit // _U(64) == w, _U(1) << bit % _U(64), _U(0))
            parity[:, w] = np.bitwise_xor.reduceat(mine, first)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * WORDS), pa.array(parity.view(np.int64).reshape(-1)))
        halves = names[entry].view(np.uint8)
        return pa.table([binaries(halves, np.full(len(n), 16)), pa.array(n), pa.array(n - shared), binaries(grams, shared), lists],
                        ["class", "n", "alone", "grams", "parity"])

    return shared.groupBy("part").applyInArrow(work, schema)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``gram, k, n, alone, at``: the shared n-grams of each prefix, and how many shared ones stand before."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, alone = batch.column("n").to_numpy(), batch.column("alone").to_numpy()
            size = n - -(-percent * n // 100) + 1 - alone
            found = [np.frombuffer(g, _U)[:k] for g, k in zip(batch.column("grams").to_pylist(), size, strict=True)]
            took = np.array([len(f) for f in found], np.int64)
            of = pa.array(np.repeat(np.arange(len(found)), took))
            at = np.arange(int(took.sum())) - np.repeat(np.cumsum(took) - took, took)
            grams = np.concatenate(found) if found else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), *(batch.column(c).take(of) for c in ("k", "n", "alone")),
                                              pa.array(at, pa.int64())], ["gram", "k", "n", "alone", "at"])

    return sets.select("k", "n", "alone", "grams").mapInArrow(work, "gram bigint, k bigint, n bigint, alone bigint, at bigint")


def _may_link(percent: int) -> Column:
    """Length and positional filter for the pair (x, y) with a common n-gram. N-grams that a class has alone
    come first in its order and are never shared, so only those after them count."""
    x_n, y_n, x_at, y_at = (F.col(c) for c in ("n", "y_n", "at", "y_at"))
    x_shared, y_shared = F.col("n") - F.col("alone"), F.col("y_n") - F.col("y_alone")
    overlap = F.least(x_at, y_at) + F.least(x_shared - x_at, y_shared - y_at)
    return ((F.least(x_n, y_n) * 100 >= F.greatest(x_n, y_n) * percent)
            & (overlap >= _least_overlap(x_n, y_n, percent)))


def _suffix_filter(percent: int) -> Column:
    """What can still be common when each part of the hashes with an odd number on one side alone holds a difference."""
    apart = sum((F.bit_count(F.col("parity")[w].bitwiseXOR(F.col("y_parity")[w])) for w in range(WORDS)), F.lit(0))
    shared = F.col("n") - F.col("alone") + F.col("y_n") - F.col("y_alone")
    return shared - apart >= 2 * _least_overlap(F.col("n"), F.col("y_n"), percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``k``, ``y``) that link, by intersecting their n-grams. Only sets that pairs name are moved."""
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    one = sets.select("k", "n", "grams")
    two = sets.select(F.col("k").alias("y"), F.col("n").alias("m"), F.col("grams").alias("other"))
    if few:
        two = two.join(F.broadcast(pairs.select("y").distinct()), "y", "left_semi")
    both = one.join(F.broadcast(pairs) if few else pairs, "k").join(two, "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            least = -(-percent * (n + m) // (100 + percent))
            x, y = batch.column("grams"), batch.column("other")
            ok = [len(np.intersect1d(np.frombuffer(x[k].as_buffer(), _U), np.frombuffer(y[k].as_buffer(), _U), assume_unique=True)) >= least[k]
                  for k in range(len(n))]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("k", "y")], ["k", "y"])

    return both.mapInArrow(work, "k bigint, y bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for all nodes of the links (``k``, ``y``).

    Every node is merged into the smallest of its neighbours and itself until no link is left. Where numbers
    say nothing about links, as with sets numbered in the order of their digests, the rounds grow with the
    logarithm of a component's length (17 for a chain of 10,000); a chain numbered in its own order would
    take a round for each node. Rounds are stored, and only counts reach the driver.
    """
    edges = stored(links.select(F.col("k").alias("a"), F.col("y").alias("b")).filter("a != b").distinct(), "links")
    roots = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        step = stored(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "labels")
        if roots is None:
            roots = step.withColumnsRenamed({"a": "node", "to": "root"})
        else:
            moved = step.withColumnsRenamed({"a": "root", "to": "new"})
            roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
        x, y = step.withColumnsRenamed({"to": "x"}), step.withColumnsRenamed({"a": "b", "to": "y"})
        edges = stored(edges.join(x, "a").join(y, "b").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if not edges.limit(1).count():
            return roots


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of all sets (numbered ``k``) that link with another one."""
    index = stored(_prefixes(sets, percent), "prefixes")
    spark, size = sets.sparkSession, index.count()
    parity = sets.select("k", "parity")
    links = spark.createDataFrame([], "k bigint, y bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    other = {"y": "k", "y_n": "n", "y_alone": "alone", "y_at": "at", "y_root": "root"}
    found = tried = 1
    for number in range(ROUNDS + 1):
        # Of each n-gram's sets, those in more than one component so far; a set without links stands for itself.
        named = index.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")) if number else index.withColumn("root", F.col("k"))
        order = F.col("alone") / F.col("n") if number == 0 else F.xxhash64("k", F.lit(number))
        one = F.struct(order.alias("rank"), *(F.col(c).alias(name) for name, c in other.items()))
        by_root = named.groupBy("gram", "root").agg(F.min(one).alias("y"), F.count(F.lit(1)).alias("c"))
        best = (by_root.groupBy("gram").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("roots"), F.sum("c").alias("copies"),
                                            F.max(F.struct("c", "root")).alias("most"))
                .filter("roots > 1").select("gram", "copies", *(f"y.{c}" for c in other),
                                            F.col("most.root").alias("main"), F.col("most.c").alias("main_size")))
        best = stored(best, "representatives")
        left = best.agg(F.sum(F.col("copies") * (F.col("copies") - F.col("main_size")))).first()[0]
        if not left:
            break
        last = number == ROUNDS or left <= 8 * size or found * 20 < tried
        if last:
            # All pairs of an n-gram's sets that aren't connected: one of the two is outside its largest component.
            live = lookup(named, best.select("gram", "copies", "main"), ["gram"], "copies").filter("copies IS NOT NULL")
            live = stored(live.join(parity, "k"), "live")
            met = live.filter("root != main").join(live.select("gram", *(F.col(c).alias(name) for name, c in (other | {"y_parity": "parity"}).items())), "gram")
        else:
            met = lookup(named, best, ["gram"], "copies").filter("y IS NOT NULL")
        pairs = met.filter(_may_link(percent) & (F.col("root") != F.col("y_root")))
        if last:
            pairs = pairs.filter(_suffix_filter(percent))
        pairs = stored(pairs.select(F.least("k", "y").alias("k"), F.greatest("k", "y").alias("y")).distinct(), "pairs")
        new = stored(_verified(pairs, sets, percent), "verified")
        found, tried = new.count(), pairs.count()
        links = stored(links.union(new), "links")
        roots = components(links)
        if last:
            break
    return roots


def _first_of_components(rows: DataFrame, place: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``doc_id``, ``text`` and others) without texts but with ``n, class``; and ``class, copies, first`` of
    all classes that have several rows or links, where ``first`` is the smallest ``place`` of the component."""
    seen = stored(_documents(rows, "text"), "documents")
    known = seen.filter("n IS NOT NULL").drop("gram", "seen")
    totals = known.agg(F.count(F.lit(1)), F.sum("n")).first()
    often = seen.filter("n IS NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).filter(F.col("seen") * HOT_SHARE >= totals[0])
    # At most HOT_SHARE n-grams for each n-gram of an average document: their counts add up to no more than all n-grams.
    hot = {r["gram"]: r["seen"] for r in often.collect()}
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(totals[1] or 0) // (2 * FLUSH)))
    grams = _gram_rows(rows.select("doc_id", "text"), "text", np.array(sorted(hot), np.int64).view(_U), parts)
    sets = stored(_candidates_of_class(_shared_grams(grams, hot, parts), percent).withColumn("k", F.monotonically_increasing_id()), "sets")
    roots = _links(sets, percent).join(sets.select(F.col("k").alias("node"), "class"), "node").select("class", "root")
    classes = known.filter("n > 0").groupBy("class").agg(F.min(place).alias("low"), F.count(F.lit(1)).alias("copies"))
    named = stored(classes.join(roots, "class", "left").filter("copies > 1 OR root IS NOT NULL"), "classes")
    lows = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("first"))
    table = named.join(lows, "root", "left").select("class", "copies", F.coalesce("first", "low").alias("first"))
    return known, stored(table, "named")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the size of the document's set of word 5-grams, and the
    smallest id that links reach from it.

    Two documents link when their sets' Jaccard similarity is at least ``percent`` / 100. Null and empty
    texts have empty sets, link with nothing and are components of their own; a null id is never the
    smallest unless the component has no other. Repeated rows are copies of each other. Extra columns are
    ignored. Sets are compared by 64-bit hashes of their n-grams.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known, table = _first_of_components(rows, F.col("doc_id"), percent)
    return lookup(known, table, ["class"], "copies").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id, null ids last, then the smallest hash of the text.

    Rows are told apart by two hashes of id and text, so they need no number that a second reading of ``docs``
    might give differently. Of rows equal in both one stays, chosen by the other columns. Rows without words
    are components of their own and all stay. Texts are moved once; repeated rows are cut in their task first.
    """
    spoken = F.coalesce(F.col(text_col).rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    same = [F.xxhash64(F.lit(k), F.col(id_col).isNull(), F.col(id_col), F.col(text_col)) for k in (1, 2)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), same[0].alias("h1"), same[1].alias("h2"))
    place = F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "h1", "h2")
    known, table = _first_of_components(rows, place, percent)
    later = lookup(known, table, ["class"], "copies").filter("first.h1 != h1 OR first.h2 != h2")
    h1, h2, turn = (fresh(docs, x) for x in ("h1", "h2", "turn"))
    gone = stored(later.select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct(), "later")
    marked = docs.withColumns({h1: F.when(spoken, same[0]).otherwise(F.monotonically_increasing_id()), h2: F.when(spoken, same[1])})
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    once = marked.withColumn(turn, F.row_number().over(Window.partitionBy(h1, h2).orderBy(F.xxhash64(F.lit(0), *others)))).filter(F.col(turn) == 1)
    return once.join(gone, [h1, h2], "left_anti").select(docs.columns)
