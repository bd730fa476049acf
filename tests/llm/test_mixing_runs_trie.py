"""Mixtures, periodic runs and prefix tries against plain versions, on edge rows and on spread-out groups."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voicegrid.llm import bytewords, mixing, periodic_runs, prefix_trie
from voicegrid.llm.common import text_buffers


def plain_runs(words, least=6, exponent=4):
    out = set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(r for r in out if not any(s <= r[0] and s + n >= r[0] + r[1] and q < r[2] and r[2] % q == 0 for s, n, q in out))


def found_runs(texts, least=6, exponent=4):
    import pyarrow as pa
    data, begins = text_buffers(pa.array(texts, pa.string()))
    words = bytewords.cut(data, begins, bytewords.NOT_SPACE)
    out = [[] for _ in texts]
    for s, n, q in periodic_runs.text_runs(words, least, exponent) if len(words.start) else []:
        out[words.doc[s]].append((s - int(words.first[words.doc[s]]), n, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4), st.sampled_from([(6, 4), (6, 3), (4, 2), (1, 2)]))
def test_runs_of_random_words(texts, rule):
    assert found_runs([" ".join(t) for t in texts], *rule) == [plain_runs(t, *rule) for t in texts]


def test_runs_of_repeated_phrases():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < 120:
            phrase = [rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 7, 12)))]
            words += phrase * rng.choice((1, 1, 3, 4, 5, 9))
        texts.append(words)
    assert found_runs([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]
    long = ["w"] * 200_000
    assert found_runs([" ".join(long)]) == [[(0, 200_000, 1)]]
    long = [f"w{i % 1000}" for i in range(100_000)]
    assert found_runs([" ".join(long + ["end"])]) == [[(0, 100_000, 1000)]]


def test_runs_table(spark):
    texts = [None, "", " \n", "a", "a a a a a a", "a a a a a", "x a b a b\ta b a b  y", "A a A a", None, "a a a a a a", "é é é é é é é"]
    rows = [(i if i != 8 else None, t, "r", "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, collapsed string").repartition(3)
    out, runs, collapsed = periodic_runs.periodic_runs(docs)
    assert out.columns == [*docs.columns, runs, collapsed] and runs == "runs_"
    got = {r.doc_id: r for r in out.collect()}
    assert {i: [tuple(x) for x in r[runs]] for i, r in got.items() if r[runs]} == {4: [(0, 6, 1)], 6: [(1, 8, 2)], 9: [(0, 6, 1)], 10: [(0, 7, 1)]}
    assert [got[i][collapsed] for i in (0, 1, 2, 3, 4, 5, 6, 10)] == [None, "", "", "a", "a", "a a a a a", "x a b y", "é"]
    best = out.select(periodic_runs.strongest(F.col(runs)).alias("b"), periodic_runs.runs_text(F.col(runs)).alias("t"), "doc_id").collect()
    assert {r.doc_id: r.t for r in best}[6] == "1,8,2\n" and {r.doc_id: r.b for r in best}[0] is None
    ties = spark.sql("SELECT array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 9L, 'length', 4L, 'period', 1L)) AS r")
    assert ties.select(periodic_runs.strongest(F.col("r"))).first()[0].start == 0
    assert periodic_runs.periodic_runs(docs.limit(0))[0].count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in stopped]
        share = {s: (total - sum(stopped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] >= most * sizes[s]]
        if not above:
            return {**stopped, **share}
        stopped |= {s: float(most * sizes[s]) for s in above}
        if len(stopped) == len(names):
            return stopped


def mixed(docs, **options):
    sized, size, weight = mixing.with_sizes(docs)
    return mixing.mixture(sized, size_col=size, weight_col=weight, **options)


def test_mixture(spark, monkeypatch):
    rng = random.Random(8)
    sources = ["a", "b", "c", "d", None, "", "é"]
    rows = [(i, " ".join("w" * rng.randrange(1, 9) if rng.random() < 0.9 else "1234" for _ in range(rng.choice((0, 1, 5, 60)))), sources[min(int(rng.expovariate(0.6)), 6)], "x", "y") for i in range(600)]
    rows += [(None, None, "a", "", ""), (None, "one two", "zero", "", ""), (None, "one two", "zero", "", ""), (7000, "", "empty", "", "")]
    rows += [(9000, "same text here", "b", "", "")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, target string")
    monkeypatch.setattr(mixing, "KEYS_PER_RANGE", 40)
    got = mixed(docs.repartition(7)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, want[s], abs_tol=1e-6) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= (300 if s == "b" else 2)
        assert all(r.taken == r.epochs * r.size + r.part_words and 0 <= r.part_words <= r.size and r.taken <= 3 * r.size for r in mine)
        if s not in ("b", "zero"):
            assert sum(0 < r.part_words < r.size for r in mine) <= 1
    assert len({(r.doc_id, r.taken) for r in got if r.doc_id == 9000}) == 1
    again = mixed(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, mixed(docs, seed=12).collect())) != sorted(map(str, got))
    assert mixed(docs.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    rows = [(i, "s", 1, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(9999, "t", 2000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, quality_weight double")
    got = [r for r in mixing.mixture(docs, weights=(1, 3)).collect() if r.source == "s"]  # a target of 1500 of 4000 words
    assert sum(r.taken for r in got) == 1500
    assert sum(r.taken for r in got if r.doc_id % 2) > 4 * sum(r.taken for r in got if r.doc_id % 2 == 0)


def plain_trie(convs):
    """conv id -> list of (role, text); rows as the operator returns them."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    rows, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        below[node] = (sum(below[k][0] for k in kids) or 1, (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(below[k][1] for k in kids))
        ends = sorted(c for c in members[node] if len(convs[c]) == len(node))
        rows.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), *below[node],
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, digest string"


def test_slot_table():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, (2 * n, 2)).astype(np.uint64)
        table = prefix_trie.SlotTable(keys[:n, 0], keys[:n, 1])
        slots = table.slots(keys[:n, 0], keys[:n, 1])
        assert sorted(slots.tolist()) == list(range(n))
        assert (table.slots(keys[n:, 0], keys[n:, 1]) == -1).all()


@pytest.mark.parametrize("shard_rows", [500_000, 9])
def test_trie(spark, monkeypatch, shard_rows):
    rng = random.Random(6)
    convs = {c: [(rng.choice("ua"), rng.choice(["", "x", "yy", "é日"])) for _ in range(rng.choice((0, 1, 2, 3, 9)))] for c in range(0, 60)}
    convs |= {100: [("u", "long")] * 90, 101: [("u", "long")] * 70 + [("a", "other")] * 40, 102: [("u", "long")] * 90}
    convs |= {103: [("a", f"t{i}") for i in range(120)], 104: [("a", f"t{i}") for i in range(60)], 105: [("a", f"t{i}") for i in range(120)]}
    convs |= {c: convs[7] for c in range(200, 230)}
    convs = {c: t for c, t in convs.items() if t}
    rows = [(c, i, r, t, "c", "d") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    turns = spark.createDataFrame([*rows, (None, 1, "u", "lost", "", "")], SCHEMA).repartition(6)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(prefix_trie, "JOINED_BYTES", 20)
    got = [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.turn_digests(turns)).collect()]
    assert sorted(got, key=str) == plain_trie(convs)


@pytest.mark.parametrize("shard_rows", [500_000, 5])
def test_trie_with_taken_turns(spark, monkeypatch, shard_rows):
    convs = {0: [("u", f"a{i}") for i in range(40)], 1: [("u", "b0"), ("a", "b1"), ("u", "b2")], 2: [("u", "c0")], 3: [("u", f"a{i}") for i in range(40)]}
    rows = [(c, i, r, t, "c", "d") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    digests = prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))
    skip = {0: 3, 1: 2, 2: 4, 3: 0}
    heads = prefix_trie.first_turns(digests.filter("conv = 0"), 5).select("head")
    taken = spark.createDataFrame(list(skip.items()), "conv bigint, skip int").join(heads).withColumn("head", F.slice("head", F.lit(1), F.col("skip")))
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    got = [tuple(r) for r in prefix_trie.prefix_trie(digests, taken).collect()]
    assert sorted(got, key=str) == plain_trie({c: convs[0][:skip[c]] + t[skip[c]:] for c, t in convs.items()})


def test_trie_edges(spark):
    rows = [(1, None, None, None, "", ""), (1, 0, "", "", "", ""), (2, 5, "", None, "", ""), (2, 5, "", None, "", ""), (3, 1, "a", "b", "", ""), (3, 1, "a", "b", "", "")]
    got = [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))).collect()]
    empty = ("", "")
    assert sorted(got, key=str) == plain_trie({1: [empty] * 2, 2: [empty] * 2, 3: [("a", "b")] * 2})
    assert prefix_trie.prefix_trie(prefix_trie.turn_digests(spark.createDataFrame([], SCHEMA))).count() == 0
