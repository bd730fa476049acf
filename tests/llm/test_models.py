"""Held-out accuracy of the two models, and their behaviour on edge rows."""

import pytest
from pyspark.sql import functions as F

from voicegrid.llm import labelled, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def held_out_rows(spark, score, label, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = score(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return rows


def test_held_out_quality(spark):
    rows = held_out_rows(spark, quality.score_quality, "quality", FOLDER)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("folder, least", [("/root/testdata/sf0.01", {"en": 1.0}), ("/root/testdata/sf0.1", {"en": 0.9, "de": 0.9, "fr": 0.9, "es": 0.8})])
def test_held_out_toxicity(spark, folder, least):
    """Recall of label 1 in each language that has enough labels, and the share of clean rows kept."""
    rows = held_out_rows(spark, toxicity.score_documents, "toxic", folder)
    caught = {}
    for lang in {r.lang for r in rows}:
        toxic, clean = ([r.predicted for r in rows if r.lang == lang and r.toxic == y] for y in (1, 0))
        caught[lang] = (sum(toxic), len(toxic), sum(clean), len(clean))
    assert all(caught[lang][0] >= share * caught[lang][1] for lang, share in least.items()), caught
    assert sum(c[2] for c in caught.values()) <= 0.02 * sum(c[3] for c in caught.values()), caught


def test_evidence_needs_no_switch():
    import numpy as np
    a, b = np.array([1.0, 8.0, 8.0, 0.0, 4.0]), np.array([0.0, 0.0, 40.0, 3.0, 0.0])
    weak, strong, none, other, few = labelled.evidence(a, b, 30, 300)
    assert 0 < weak < few < labelled.LEAST_EVIDENCE < strong and other == 0 and none < 3
    assert (labelled.evidence(np.zeros(2), np.ones(2), 0, 9) == 0).all()


@pytest.mark.parametrize("score", [toxicity.score_documents, quality.score_quality])
def test_edges(spark, score):
    rows = [(None, "you idiot", "x"), (1, None, "x"), (1, None, "x"), (2, "", "x"), (3, "wort " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, probability string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0)], none.schema)
    for labels in (none, some):
        out = score(docs, labels).collect()
        assert len(out) == 5 and all(r.score is not None for r in out)
    assert score(docs.limit(0), some).count() == 0


def test_no_label_reaches_a_held_out_row(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_ranking(docs, x) for x in (labels, turned))
    assert a.weights == pytest.approx(b.weights)


def test_quality_learns_from_every_label(spark):
    """More labels than any former sample: each kind's rows are all counted, in the scale and in the cut."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("#### "), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("a plain sentence of words, number "), F.col("id").cast("string"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    rows = quality.text_features(docs).filter(~labelled.held_out(F.col("doc_id")))
    means = rows.agg(F.avg(F.col("features")[0])).first()[0]
    ranking = quality.fit_ranking(docs, labels)
    assert rows.count() > 20_000 and ranking.scale[0] == pytest.approx(means, rel=1e-9)
    u = rows.agg(F.stddev_pop(quality.utility(F.col("features"), ranking.scale, ranking.weights))).first()[0]
    assert ranking.spread == pytest.approx(u, rel=1e-9)


def test_best_cut_is_that_of_all_rows(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.8).astype(float)
    u = np.round(rng.normal(size=3000) + y, 1)
    u[:700] = 0.25  # a value that many quantiles share
    levels = np.quantile(u, np.linspace(0.005, 0.995, 199))
    rates = [((u >= t)[y == 1].mean() + (u < t)[y == 0].mean()) / 2 for t in levels]
    want = levels[np.isclose(rates, max(rates))].mean()
    rows = spark.createDataFrame(list(zip(y.tolist(), u.tolist(), strict=True)), "y double, u double").repartition(5)
    assert quality.best_cut(rows, {1.0: int(y.sum()), 0.0: int((1 - y).sum())}) == pytest.approx(want, abs=1e-12)
