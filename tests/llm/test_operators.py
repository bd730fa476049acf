"""Every operator on edge rows, against plain versions: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import glob
import hashlib
import random
import zlib

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from voicegrid.llm import common, decontaminate, exact_dedup, line_dedup, ngram_join, packing, piece_counts, token_files, tokens, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string, hits string, features string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    long, passage = words(rng, 20000, 10 ** 6), " ".join(words(rng, 60, 10 ** 6))
    base = words(rng, 120, 10 ** 6)
    out = [None, "", " \n\t", "one", "one", "ONE", "a b c", "A b  c", "a b c d e", " ".join(long), " ".join(long[:-3] + ["x"]),
           "\n".join([passage, "tail one"]), "\n".join(["head two", passage]), "\n".join(["x", passage, passage, "é ß 日本 İ"])]
    out += [" ".join(base[:k] + [f"new{k}"] + base[k:]) for k in range(0, 120, 3)]
    out += ["\n".join(" ".join(words(rng, rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return out + out[3:20]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "s", None, "k", None, "h", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id, and repeated rows."""
    rows = [(i, t, "l", "s", 1, "k", None, "h", "f") for i, t in [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"),
                                                                   (3, None), (3, None), (None, None), (9, "other")]]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact(docs, texts, odd, empty):
    want = {}
    for i, t in enumerate(texts):
        want.setdefault((t or "").translate(brute.LOWER), []).append(i)
    for digest in (lambda c: F.unhex(F.md5(c)), lambda c: F.substring(F.md5(c), 1, 1)):  # the second one collides
        got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, digest=digest).collect()}
        for text, ids in want.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
                assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == 8 and sum(r.kept for r in rows) == 3
    assert {(r.keep_id, r.group_size) for r in rows if r.group_size == 4} == {(7, 4)}


def test_lookup_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "HEAVY_SHARE", 3)
    rows = spark.range(90).select((F.col("id") % 10 * (F.col("id") % 2)).alias("k"), "id")
    table = rows.filter("k < 8").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.lookup(rows, table, ["k"], "n").collect()
    assert len(got) == 90 and all((r.n is None) == (r.k >= 8) for r in got)


def test_near(docs, texts, odd, empty, monkeypatch):
    want = brute.near(list(enumerate(texts)))
    for flush in (1_000_000, 300):
        monkeypatch.setattr(ngram_join, "FLUSH", flush)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
        assert got == want
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = ngram_join.near_duplicates(odd).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [
        (-1, 0, -1), (-1, 2, 7), (-1, 2, 7), (3, 0, 3), (3, 0, 3), (7, 2, 7), (7, 2, 7), (9, 1, 9)]
    assert ngram_join.without_near_duplicates(docs).columns == docs.columns


def test_one_row_of_each_near_group(spark):
    rng = random.Random(21)
    base = words(rng, 100, 10 ** 6)
    a, b = " ".join(base), " ".join([*base[:-1], "new"])
    other, lone, far = (" ".join(words(rng, 30, 10 ** 6)) for _ in range(3))
    rows = [(5, a, "x"), (5, a, "y"), (5, b, "x"), (7, b, "x"), (None, a, "x"), (None, lone, "x"), (3, far, "x"), (3, other, "x"), (4, other, "x"),
            (None, b, "x"), (None, "one two", "p"), (None, "one two", "q"), (None, None, "x"), (None, None, "x"), (9, " ", "x"), (9, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h1 string").repartition(4)
    got = [tuple(r) for r in ngram_join.without_near_duplicates(docs).collect()]
    texts = sorted((r[1] or "").strip() for r in got)
    assert [t for t in texts if t not in (a, b)] == sorted(["", "", "", "", other, lone, far, "one two"])
    assert len([r for r in got if r[1] in (a, b)]) == 1 and {r[0] for r in got if r[1] in (a, b)} == {5}
    assert {r[0] for r in got if r[1] in (far, other)} == {3} and set(got) <= set(rows)


def test_lines(docs, texts, odd, empty):
    want = brute.line_runs(list(enumerate(texts)))
    out, lines, _ = line_dedup.without_repeated_lines(docs)
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and any(r[lines] for r in rows)
    assert line_dedup.without_repeated_lines(empty)[0].count() == 0
    assert line_dedup.without_repeated_lines(odd)[0].count() == 8


def test_lines_of_whole_runs(spark):
    rng = random.Random(12)
    lines = [" ".join(words(rng, n)) for n in (7, 25, 25, 3, 4)]
    texts = ["\n".join(["before", *lines, "after"]), "\n".join(["other", *lines, "end"]), "\n".join([*lines[1:], " ", "\r"]), "\n".join([*lines[1:], " ", "\r"])]
    pool = [" ".join(words(rng, n)) for n in (1, 2, 5, 8, 13, 21, 40, 45)] + [" "]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs)[0].collect()}
    assert got == brute.line_runs(list(enumerate(texts)))
    assert got[1] == "other\nend" and got[3] == ""


def test_lines_of_very_long_texts(spark):
    rng = random.Random(13)
    passage = " ".join(words(rng, 60))
    blank = " \n" * 2_000_000
    short = "\n".join(f"w{rng.randrange(10 ** 9)}" for _ in range(200_000))
    texts = [blank, passage + "\n" + blank + "end", short, "x\n" + passage, short + "\nmore", "\n" * 300_000 + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out, lines, cut = line_dedup.without_repeated_lines(docs)
    got = {r.doc_id: (r.text, r[lines]) for r in out.collect()}
    assert got[0] == (blank, 0) and got[1] == (texts[1], 0) and got[2] == (short, 0)
    assert got[3] == ("x", 1) and got[4] == ("more", 200_000) and got[5] == ("\n" * 299_999, 1)


def test_last_smallest():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 300).astype(np.uint64)
    first = rng.integers(0, 300, 2000)
    last = np.minimum(299, first + rng.integers(0, 300, 2000) // rng.integers(1, 40, 2000))
    want = [max(k for k in range(a, b + 1) if values[k] == values[a:b + 1].min()) for a, b in zip(first, last)]
    assert line_dedup.last_smallest(values, first, last).tolist() == want
    assert len(line_dedup.last_smallest(values[:0], first[:0], last[:0])) == 0


def test_benchmark(spark, docs, texts, odd, empty):
    rng = random.Random(9)
    items = [(k, " ".join(x.split()[:k])) for k, x in enumerate(t for t in texts if t and len(t.split()) > 40)][5:30]
    items += [(100, "ONE"), (101, None), (102, ""), (103, "b, c"), (104, "É"), (105, " ".join(words(rng, 30)))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n_words int")
    want = {i: brute.hits(t, items) for i, t in enumerate(texts)}
    for limit in (1 << 20, 400):  # one search, and several
        got = decontaminate.contamination(docs, bench, limit=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.without_benchmark(odd, bench.limit(0)).count() == 8


def test_benchmark_structure_is_bounded(spark, monkeypatch):
    rng = random.Random(17)
    items = [(str(k), " ".join(words(rng, 2000, 10 ** 5))) for k in range(60)]
    machines = decontaminate.machines_of(items)
    size = sum(len(t) for _, t in items)
    assert [m.size for m in machines] == [10] and machines[0].nbytes < 14 * size and len(machines[0].places) == 60 * 1991
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 300)  # items longer than a search holds
    docs = spark.createDataFrame([(1, items[7][1]), (2, " ".join(items[9][1].split()[295:309])), (3, "x " + " ".join(items[9][1].split()[:9]))], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), limit=size // 7).collect()}
    assert got == {1: (2000, ["7"]), 2: (14, ["9"]), 3: (0, [])}


def test_token_files(spark, docs, texts, odd, empty, tmp_path):
    path, file = str(tmp_path / "ids"), tokens.default_tokenizer()
    token_files.write_token_files(docs, path, file)
    rows = token_files.with_checksums(token_files.read_documents(spark, path)).orderBy("doc_id").collect()
    library, start = tokens.WordTokenizer(file).library, 0
    for r, t in zip(rows, texts, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = token_files.read_documents(spark, path, [12])
    assert "PushedFilters: [In(doc_id, [12])" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,12)" in one._jdf.queryExecution().toString()
    assert [r.start for r in one.collect()] == [rows[12].start]
    assert all(orc.ORCFile(f).nstripes >= 1 for f in glob.glob(f"{path}/*.orc"))
    for k, df in enumerate((odd, empty)):
        token_files.write_token_files(df, f"{path}{k}", file)
        assert token_files.read_documents(spark, f"{path}{k}").count() == df.count()


def test_tokenizer_on_odd_characters():
    own = tokens.WordTokenizer(tokens.default_tokenizer())
    rng, pool = random.Random(1), "aZéÉ' \n.1½²<|>İΣςσ日\xa0\x85\x1f́ßŉ!"
    cases = ["don't STOP it'S", "<|endoftext|>x", "ΟΔΟΣ á", "ﬁ Å"] + ["".join(rng.choice(pool) for _ in range(30)) for _ in range(500)]
    for text in cases:
        assert np.frombuffer(own.encode(text.encode()), own.type).tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, texts, odd, empty, capacity):
    file = tokens.default_tokenizer()
    rows = packing.pack(docs, file, capacity=capacity, group_pieces=20).collect()
    library = tokens.WordTokenizer(file).library
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(m[1] for m in mine) == len(ids)
        for a, n, crc, total in mine:
            assert total == len(ids) and zlib.crc32(ids[a:a + n].tobytes()) == crc
        assert [m[0] for m in mine] == np.r_[0, np.cumsum([m[1] for m in mine])[:-1]].tolist()
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in held.values())
    assert packing.pack(empty, file).count() == 0
    pieces = packing.pack(odd, file).collect()
    assert sum(r.start == 0 for r in pieces) == 8 and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_packing_deals_only_rests(spark):
    capacity, group = 64, 20
    rows = [(i, f"t{i} " * (64 * 30 + 10 + i)) for i in range(30)] + [(99, "one " * (64 * 50 - 1)), (99, "one " * (64 * 50 - 1)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    pieces = packing.pack(docs, tokens.default_tokenizer(), capacity=capacity, group_pieces=group).collect()
    dealt, sequences = {}, {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
        if r.sequence_id < 1 << 62:
            dealt[r.sequence_id >> 32] = dealt.get(r.sequence_id >> 32, 0) + r.length
    assert sum(dealt.values()) == sum(r.doc_tokens % capacity for r in pieces if r.start == 0) and max(dealt.values()) <= 2 * group * capacity
    assert all(len(s) == 1 and s[0].length == capacity and s[0].start % capacity == 0 for n, s in sequences.items() if n >= 1 << 62)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_first_fit_decreasing():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        bins, room = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                at = len(room)
                bins.append([])
                room.append(100)
            bins[at].append(i)
            room[at] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == bins


def test_pieces(docs, texts, odd, empty):
    rng = random.Random(4)
    for _ in range(300):
        first = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))}
        inner = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))}
        counter = piece_counts.PieceCounter(first, inner)
        for _ in range(20):
            word = bytes(rng.choice(b"abc") if rng.random() < 0.02 else rng.choice(b"ab") for _ in range(rng.randrange(0, 9)))
            assert counter.count(word) == brute.greedy(word, first, inner)
    import public_tokenizers
    file = public_tokenizers.path("byte_bpe_50k.json")
    first, inner = map(set, piece_counts.pieces_of_file(file))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in piece_counts.piece_counts(docs, file).collect()}
    for i, t in enumerate(texts[:60]):
        cut = (t or "").encode().split()
        assert got[i] == (len(cut), sum(brute.greedy(w, first, inner) for w in cut))
    assert piece_counts.piece_counts(empty, file).count() == 0 and piece_counts.piece_counts(odd, file).count() == 8


def test_archives(spark, tmp_path):
    rng = random.Random(8)
    htmls = [None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 50, "é" * 50, "\r\n\r\n" * 40, "z" * 3_000_000]
    pages = [(i, f"http://www.{rng.choice('abc')}.org/{rng.randrange(4)}?q#f" if i % 7 else None, h, "clash") for i, h in enumerate(htmls * 6)]
    pages += [(None, "bad url [", "y" * 100, None), (5, "HTTP://B.org:80/", "q" * 200, None), (5, "HTTP://B.org:80/", "q" * 200, None)]
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest string").repartition(4)
    path = str(tmp_path / "a")
    runs = warc.write_archives(df, path, F.concat(F.lit("2024-01-0"), (F.col("page_id") % 9).cast("string")))
    index = warc.merge_index(runs, str(tmp_path / "i"))
    got = sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.read_archives(index, path).collect()), key=str)
    firsts = {}
    for i, _, h, _ in pages:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    want = []
    for i, _, h, _ in pages:
        body = (h or "").encode()
        again = len(body) >= 100 and i != firsts[h]
        want.append((-1 if i is None else i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                     firsts[h] if again else None))
    assert got == sorted(want, key=str)
    ordered = []
    for f in sorted(glob.glob(str(tmp_path / "i" / "part-*"))):
        ordered += [warc.capture_order(r.asDict()) for r in spark.read.parquet(f).collect()]
    assert [(u, t or "") for u, t, *_ in ordered] == sorted((u, t or "") for u, t, *_ in ordered) and len(ordered) == len(pages)
    none = warc.merge_index(warc.write_archives(df.limit(0), path + "e", F.lit("2024")), str(tmp_path / "ie"))
    assert warc.read_archives(none, path + "e").count() == 0


def test_index_of_many_ranges(spark, tmp_path, monkeypatch):
    """One URL with most captures, more captures than a range may hold, and runs that are read only as far as needed."""
    rng = random.Random(31)
    monkeypatch.setattr(warc, "CAPTURES_PER_RANGE", 50)
    rows = [("org,a)/" if i % 3 else f"org,{rng.choice('bcd')})/", rng.choice(["2024", "2025", None]), rng.choice([i, None]), f"f{i % 7}", i, 10, f"f{i % 7}") for i in range(2000)]
    runs = spark.createDataFrame(rows, warc.RUN_SCHEMA).repartition(5)
    warc.merge_index(runs, str(tmp_path / "i"))
    files = [spark.read.parquet(f).collect() for f in sorted(glob.glob(str(tmp_path / "i" / "part-*")))]
    assert len(files) >= 30 and max(len(f) for f in files) <= 200
    got = [warc.capture_order(r.asDict()) for f in files for r in f]
    assert got == sorted(got) and len(set(got)) == 2000
    taken = []
    tree = warc.LoserTree([(taken.append(x) or x for x in range(k, 100, 3)) for k in range(3)], lambda x: x)
    assert [x for x, _ in zip(tree, range(5))] == [0, 1, 2, 3, 4] and len(taken) <= 9


def test_loser_tree():
    rng = random.Random(2)
    for k in range(1, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([], lambda x: x)) == []
