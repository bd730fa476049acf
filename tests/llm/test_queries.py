"""The registered queries against their SQL, and the pipeline stage by stage against plain versions."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.oracle_check import connect, rows_of
from voicegrid.llm.common import stored
from voicegrid.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert name in entry.queries()
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        cur = connect(FOLDER).execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert rows_of(df.columns, rows) == rows_of(names, cur.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stored(stage(spark, docs, FOLDER), "stage")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in rows} if name != "packing" else {}
        ordered = sorted(before.items())
        if name == "toxicity":
            assert after.items() <= before.items() and len(after) > 0.8 * len(before)
        if name == "line_dedup":
            want = brute.line_runs(ordered)
            assert after == {d: t for d, t in want.items() if t == before[d] or (t or "").strip(" ")}
        if name == "ngram_join":
            assert set(after) == {d for d, (_, low) in brute.near(ordered).items() if d == low}
        if name == "decontamination":
            assert set(after) == {d for d, t in ordered if not brute.hits(t, items)[1]}
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
        docs = out
