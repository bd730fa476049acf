"""Each stage of the corpus pipeline on edge rows: nulls, empty texts, repeated rows, rows without an id, clashing columns, empty tables."""

import pytest

import corpus_pipeline
from voicegrid.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, hits string, runs string, cut_lines string, number string, start string"


@pytest.fixture(scope="module")
def rows(spark):
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("length(text) > 200").first().text
    long = "\n".join(" ".join(f"word{k * 50 + i}" for i in range(50)) for k in range(4))
    near = long.replace("word7 ", "other ")
    toxic = "You are a stupid pathetic worthless idiot and a loser, you disgusting clown. " * 3
    texts = [(None, None), (None, "alone here"), (1, None), (2, ""), (3, " \n "), (4, "one two three"), (4, "one two three"),
             (5, "before " + passage + " after"), (6, long), (7, near), (8, "plain words of no note"), (9, toxic)]
    return [(i, t, None, "s", len(t or ""), "c", "c", "c", "c", "c", "c") for i, t in texts]


def stages():
    return dict(corpus_pipeline.STAGES)


def texts_after(spark, name, rows, folder=FOLDER):
    out = stages()[name](spark, spark.createDataFrame(rows, COLUMNS).repartition(3), folder)
    assert name == "packing" or out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def ids(found):
    return sorted((i for i, _ in found), key=str)


def test_stage_names():
    assert list(stages()) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_toxicity(spark, rows):
    # No label of the table belongs to these texts.
    others = [(r[0] + 90_000 if r[0] is not None else None, *r[1:]) for r in rows]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    more = [*others, *[(d.doc_id, d.text, d.lang, d.source, d.n_chars, *"cccccc") for d in docs]]
    got = [i for i in ids(texts_after(spark, "toxicity", more, "/root/testdata/sf0.01")) if i is None or i >= 90_000]
    assert got == ids((r[0], 0) for r in others if r[0] != 90_009)


def test_line_dedup(spark, rows):
    got = dict(texts_after(spark, "line_dedup", [r for r in rows if r[0] is not None]))
    want = {r[0]: r[1] for r in rows if r[0] is not None}
    # The lines that document 7 shares with document 6 go; its first line differs.
    want[7] = want[7].split("\n")[0]
    assert got == want
    repeated = texts_after(spark, "line_dedup", [rows[8], rows[8], rows[0], rows[0]])
    assert ids(repeated) == [6, 6, None, None] and {t for _, t in repeated} == {None, rows[8][1]}


def test_line_dedup_drops_what_is_left_empty(spark, rows):
    copy = (70, *rows[8][1:])
    got = stages()["line_dedup"](spark, spark.createDataFrame([rows[8], copy], COLUMNS), FOLDER).collect()
    assert [(r.doc_id, r.n_chars) for r in got] == [(6, len(rows[8][1]))]


def test_ngram_join(spark, rows):
    got = texts_after(spark, "ngram_join", rows)
    assert ids(got) == sorted([None, None, 1, 2, 3, 4, 5, 6, 8, 9], key=str)


def test_decontamination(spark, rows):
    assert ids(texts_after(spark, "decontamination", rows)) == ids((r[0], 0) for r in rows if r[0] != 5)


def test_packing(spark, rows):
    out = stages()["packing"](spark, spark.createDataFrame(rows, COLUMNS), FOLDER).collect()
    assert sorted((r.doc_id for r in out if r.start == 0), key=str) == ids((r[0], 0) for r in rows)
    assert {r.doc_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"])
def test_empty_table(spark, name):
    assert stored(stages()[name](spark, spark.createDataFrame([], COLUMNS), FOLDER), "empty").count() == 0
