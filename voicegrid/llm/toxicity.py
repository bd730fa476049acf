"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.common import fresh, stored
from voicegrid.llm.labelled import SAMPLE, fold_of, held_out, telling_terms, training_texts, with_features
from voicegrid.llm.text_features import Terms

THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    """Trees and calibration; without trees (too few labels of either kind) every score is ``constant``."""

    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    terms: Terms | None
    constant: float = 0.0


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, rounds: int = 12,
                 depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents outside the held-out quarter.

    Half of them may be of either label. Terms that toxic texts use are added to the lexicon; each text gets
    its features with terms learned without it and its fold. Trees grown on each half of the rows score the
    other half, and these scores calibrate; the trees that are kept grow on all rows. So neither step is fitted
    to what an earlier one has learned by heart, and every label is used, at every size alike.
    """
    rows = training_texts(docs, labels, label, sample, id_col, text_col, of_each=True)
    share = rows.agg(F.avg("y"), F.count(F.lit(1))).first()
    if not share[1] or share[0] in (0.0, 1.0):
        return ToxicityModel(None, None, None, share[0] or 0.0)
    terms = telling_terms(rows)
    folds = []
    for k, without in enumerate(terms[:-1]):
        out, features = with_features(rows.filter(fold_of() == k), "text", without)
        folds.append(out.select("y", "weight", F.lit(k).alias("fold"), F.col(features).alias("values")))
    rows = stored(functools.reduce(DataFrame.unionByName, folds), "features").withColumn("features", array_to_vector("values"))

    def grow(some: DataFrame) -> GBTClassificationModel:
        return GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.3,
                             minInstancesPerNode=5, seed=1).fit(some)

    halves = [rows.filter(F.col("fold") % 2 == k) for k in range(2)]
    trees = grow(rows)
    both = all(h.select("y").distinct().count() == 2 for h in halves)
    scored = [grow(halves[1 - k]).transform(halves[k]) for k in range(2)] if both else [trees.transform(rows)]
    raw = functools.reduce(DataFrame.unionByName, [s.select("y", "weight", vector_to_array("probability")[1].alias("raw")) for s in scored])
    # Most rows share few scores: one row per score and label is all that the calibration needs.
    raw = raw.groupBy("raw", "y").agg(F.sum("weight").alias("weight"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="y", weightCol="weight", predictionCol="score").fit(raw)
    return ToxicityModel(trees, calibration, terms[-1])


def toxicity_scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score from 0 to 1, and that column's name. Null and empty texts have all-zero features
    and are scored by them. Rows are independent, and columns of ``docs`` are kept whatever their names."""
    name = fresh(docs, "score")
    if model.trees is None:
        return docs.withColumn(name, F.lit(float(model.constant))), name
    out, features = with_features(docs, text_col, model.terms)
    vector, raw, p, guess, one = (fresh(out, x) for x in ("vector", "raw", "p", "guess", "one"))
    trees = model.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(guess)
    scored = trees.transform(out.withColumn(vector, array_to_vector(features)))
    scored = scored.withColumn(one, vector_to_array(p)[1])
    scored = model.calibration.copy().setFeaturesCol(one).setPredictionCol(name).transform(scored)
    return scored.select(*docs.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), name)).alias(name)), name


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, repeated rows and null ids included."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, score = toxicity_scores(kept, fit_toxicity(kept, labels, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
                      (F.col(score) >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with the columns they had."""
    out, score = toxicity_scores(docs, fit_toxicity(docs, labels, **options))
    return out.filter(F.col(score) < threshold).select(docs.columns)
