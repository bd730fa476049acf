"""Quality scores by Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.llm.common import fresh, stored
from voicegrid.llm.labelled import held_out, known_labels, with_features
from voicegrid.llm.text_features import Features
from voicegrid.operators import rank as R
from voicegrid.session import broadcast_if_small

THRESHOLD = 0.7
DEALS = 4  # how often each labelled row is dealt to a bucket of pairs
SIZE = len(Features.names)


@dataclass
class Ranking:
    """Weights of the basis functions, and the utility of the quantile that the threshold stands for."""

    scale: list[float]
    weights: list[float]
    cut: float
    spread: float


def basis(features: Column, scale: list[float]) -> Column:
    """Each feature relative to its scale, and its square, so that a preferred range can lie in the middle."""
    relative = [features[k] / F.lit(float(s)) for k, s in enumerate(scale)]
    bounded = [r / (1 + r) for r in relative]
    return F.array(*bounded, *[b * b for b in bounded])


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every row, stored: fitting and scoring read them, and texts are read once."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, name = with_features(kept, "text")
    return stored(out.select("doc_id", F.col(name).alias("features")), "features")


def fit_ranking(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                text_col: str = "text") -> Ranking:
    """Learn utilities from the texts of all labelled documents that aren't held out (see ``fit_utilities``)."""
    return fit_utilities(text_features(docs, id_col, text_col), labels, label)


def fit_utilities(features: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """Learn utilities from pairs of a preferred and another document among all labelled ones.

    The probability that one is preferred is the logistic function of the difference of their utilities,
    which are linear in the basis: logistic regression without intercept on differences. Pairs are formed
    inside random buckets of about two rows of the rarer kind, ``DEALS`` times, so their number grows with
    that of the labels. The cut is the quantile of the labelled rows' utilities that separates the labels best
    (in the mean of both kinds' hit rates). Without labels of both kinds all weights are 0 and every document
    reaches the threshold.
    """
    known = broadcast_if_small(known_labels(labels, label))
    rows = stored(features.filter(~held_out(F.col("doc_id"))).join(known, "doc_id").select("doc_id", "y", "features"), "training")
    kinds = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(kinds) < 2:
        return Ranking([1.0] * SIZE, [0.0] * 2 * SIZE, 0.0, 1.0)
    means = rows.agg(*[F.avg(F.col("features")[k]).alias(f"m{k}") for k in range(SIZE)]).first()
    scale = [max(float(m), 1e-4) for m in means]
    buckets = max(1, min(kinds.values()) // 2)
    dealt = (rows.withColumn("deal", F.explode(F.sequence(F.lit(1), F.lit(DEALS))))
             .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "deal"), F.lit(buckets))))
    good = dealt.filter("y = 1").select("deal", "bucket", F.col("features").alias("won"))
    bad = dealt.filter("y = 0").select("deal", "bucket", F.col("features").alias("lost"))
    pairs = good.join(bad, ["deal", "bucket"])
    ahead = F.zip_with(basis(F.col("won"), scale), basis(F.col("lost"), scale), lambda a, b: a - b)
    size = pairs.agg(Summarizer.normL2(array_to_vector(ahead)).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    # A difference and its reverse have the same loss, so each pair is taken once, either way round; the
    # deviation that the penalty is relative to is that of both ways together.
    spread = [float(v) * (2 / (2 * size["n"] - 1)) ** 0.5 or 1.0 for v in size["norm"]]
    way = F.when(F.col("deal") % 2 == 0, 1.0).otherwise(-1.0)
    unit = F.zip_with(ahead, F.array(*map(F.lit, spread)), lambda d, s: d / s * way)
    once = pairs.select(array_to_vector(unit).alias("d"), ((way + 1) / 2).alias("y"))
    model = LogisticRegression(featuresCol="d", labelCol="y", fitIntercept=False, standardization=False, regParam=1e-4, maxIter=100).fit(once)
    weights = [float(w) / s for w, s in zip(model.coefficients, spread, strict=True)]
    found = rows.select("y", utility(F.col("features"), scale, weights).alias("u"))
    cut = best_cut(found, kinds)
    return Ranking(scale, weights, cut, float(found.agg(F.stddev_pop("u")).first()[0] or 1.0))


def best_cut(rows: DataFrame, kinds: dict[float, int], probs: Sequence[float] = tuple(np.linspace(0.005, 0.995, 199))) -> float:
    """The mean of those quantiles of ``u``, over all rows, at which the labels ``y`` part best.

    ``kinds`` has the number of rows of each label. Quantiles are interpolated between the exact order
    statistics, which are read off the running counts of distinct values; the rows between each two
    quantiles are counted, so the driver sees a few numbers for each of ``probs``.
    """
    at = (sum(kinds.values()) - 1) * np.asarray(probs)
    below, above = np.floor(at).astype(int), np.ceil(at).astype(int)
    wanted = F.array(*[F.lit(int(i)) for i in sorted({*below, *above})])
    values = R.distinct_positions(R.long_values(rows, ["u"], R.cut_points(rows, ["u"])))
    inside = F.filter(wanted, lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("n")))
    value = {r["at"]: r["value"] for r in values.select(F.explode(inside).alias("at"), "value").collect()}
    levels = np.array([value[i] + (value[j] - value[i]) * (x - i) for i, j, x in zip(below, above, at, strict=True)])
    edges = np.unique(levels)
    counts = {y: np.zeros(len(edges) + 1) for y in (0.0, 1.0)}
    for r in R.add_region(rows, "u", edges.tolist(), "region").groupBy("y", "region").count().collect():
        counts[r["y"]][int(r["region"])] = r["count"]
    under = {y: np.cumsum(n)[np.searchsorted(edges, levels)] / kinds[y] for y, n in counts.items()}
    rates = (1 - under[1.0] + under[0.0]) / 2
    best = np.flatnonzero(np.isclose(rates, rates.max()))
    return float(levels[best].mean())


def utility(features: Column, scale: list[float], weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(basis(features, scale), F.array(*map(F.lit, weights)), lambda x, w: x * w),
                       F.lit(0.0), lambda a, v: a + v)


def scores_of(features: Column, ranking: Ranking, threshold: float = THRESHOLD) -> Column:
    """A score from 0 to 1, rising with the utility and equal to ``threshold`` at the cut."""
    ahead = (utility(features, ranking.scale, ranking.weights) - ranking.cut) / ranking.spread
    odds = F.lit(float(np.log(threshold / (1 - threshold)))) + 4 * ahead
    return F.when(ahead == 0, F.lit(threshold)).otherwise(1 / (1 + F.exp(-odds)))


def quality_scores(docs: DataFrame, ranking: Ranking, text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` with a score (see ``scores_of``), and that column's name. Null and empty texts have all-zero
    features and are scored by them."""
    name = fresh(docs, "score")
    out, features = with_features(docs, text_col)
    return out.select(*docs.columns, scores_of(F.col(features), ranking, threshold).alias(name)), name


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, repeated rows and null ids included."""
    rows = text_features(docs, id_col, text_col)
    score = scores_of(F.col("features"), fit_utilities(rows, labels, **options), threshold)
    out = rows.select("doc_id", score.alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
