"""Company comparisons: gaps, grids, winners and summary lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from voicegrid import dims
from voicegrid.functions import scores as S
from voicegrid.operators.rollups import known_keys, name_grid


def primary_vs_company_trend(df: DataFrame, primary: str, company: str, value: str) -> DataFrame:
    """Monthly mean of one score for both companies, side by side, in one pass."""
    both = df.filter(F.col("company").isin(primary, company))
    return known_keys(both, ["month"]).groupBy("month").agg(
        F.avg(F.when(F.col("company") == company, F.col(value))).alias("company_score"),
        F.avg(F.when(F.col("company") == primary, F.col(value))).alias("primary_score")).orderBy("month")


def latest_scores(df: DataFrame, aspects: Sequence[str], order: Sequence[str] = ("month",)) -> DataFrame:
    """``(company, product, aspect, score)`` of each pair's latest rollup row."""
    scores = F.struct(*[F.col(f"{a}_sentiment_score").alias(a) for a in aspects])
    latest = df.groupBy("company", "product").agg(
        F.max_by(scores, F.struct(*order)).alias("_latest")).select("company", "product", "_latest.*")
    return latest.unpivot(["company", "product"], list(aspects), "aspect", "score")


def latest_gap(df: DataFrame, primary: str, aspects: Sequence[str]) -> DataFrame:
    """Primary minus competitor per product and aspect, from each one's latest rollup row.

    The primary score is spread over the companies of a product by a window on the latest rows,
    one per company, instead of joining the rollup with itself.
    """
    sides = _with_primary(latest_scores(df, aspects), primary, "score", ["product", "aspect"])
    return sides.select(
        F.col("company").alias("competitor"), "product", "aspect",
        S.half_even(F.col("_ours") - F.col("score"), 2).alias("sentiment_difference"))


def _with_primary(scores: DataFrame, primary: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Competitor rows with the primary company's value of the same keys; keys it lacks drop out."""
    w = Window.partitionBy(*keys)
    is_primary = F.col("company") == primary
    marked = scores.withColumns({"_ours": F.max(F.when(is_primary, F.col(value))).over(w),
                                 "_sold": F.max(is_primary).over(w)})
    return marked.filter((F.col("company") != primary) & F.col("_sold")).drop("_sold")


def annual_gap(scores: DataFrame, cells: DataFrame, primary: str) -> DataFrame:
    """Scores of both companies and their difference for every cell; NULL where one is missing.

    ``cells`` has year, competitor, product and aspect; ``scores`` the annual aspect scores.
    """
    ids = ["year", "product", "aspect"]
    ours = scores.filter(F.col("company") == primary).select(
        *ids, F.col("sentiment_score").alias("primary_score"))
    theirs = scores.select(*ids, F.col("company").alias("competitor"),
                           F.col("sentiment_score").alias("competitor_score"))
    return (cells.join(ours, ids, "left").join(theirs, [*ids, "competitor"], "left")
            .select("year", "competitor", "product", "aspect", "primary_score", "competitor_score",
                    (F.col("primary_score") - F.col("competitor_score")).alias("sentiment_difference")))


def comparison_grid(df: DataFrame, primary: str, aspects: Sequence[str]) -> DataFrame:
    """Every competitor x product x aspect; built from names, not from review rows."""
    grid = name_grid(df, "company", "product").filter(F.col("company") != primary)
    return grid.select(F.col("company").alias("competitor"), "product",
                       F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"))


def common_products(df: DataFrame, primary: str) -> DataFrame:
    """Per year and competitor, the products that both have reviews for."""
    sold = df.select("year", "company", "product").distinct()
    ours = sold.filter(F.col("company") == primary).select("year", "product")
    return (sold.filter(F.col("company") != primary).join(ours, ["year", "product"])
            .select("year", F.col("company").alias("competitor"), "product"))


def market_split(df: DataFrame, primary: str, value: str) -> DataFrame:
    """Primary company against everyone else per year and product."""
    is_primary = F.col("company") == primary
    return known_keys(df, ["year", "product"]).groupBy("year", "product").agg(
        F.count_if(is_primary).alias("primary_reviews"),
        F.count_if(~is_primary).alias("market_reviews"),
        F.avg(F.when(is_primary, F.col(value))).alias("primary_score"),
        F.avg(F.when(~is_primary, F.col(value))).alias("market_score"))


def best_competitor(df: DataFrame, aspects: Sequence[str], min_volume: int = 100,
                    primary: str | None = None) -> DataFrame:
    """Per aspect the company with the best single rollup row of enough volume.

    The primary company may win unless it is named in ``primary``. Earlier months and then
    names decide ties.
    """
    rows = df if primary is None else df.filter(F.col("company") != primary)
    long = rows.select("company", "product", "month", F.explode(F.array(*[
        F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_sentiment_score").cast("double").alias("score"),
                 F.col(f"{a}_volume").cast("bigint").alias("volume")) for a in aspects])).alias("_a"))
    long = long.select("company", "product", "month", "_a.*").filter(
        (F.col("volume") >= min_volume) & F.col("score").isNotNull())
    w = Window.partitionBy("aspect").orderBy(F.desc("score"), "month", "company", "product")
    return (long.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 1)
            .select("aspect", "company", "score"))


def aspect_gap(df: DataFrame, primary: str, aspects: Sequence[str]) -> DataFrame:
    """Mean of both sides and competitor minus primary, rounded after the subtraction."""
    means = df.groupBy("company").agg(*[F.avg(f"{a}_sentiment_score").alias(a) for a in aspects])
    long = means.unpivot(["company"], list(aspects), "aspect", "_m")
    return _with_primary(long, primary, "_m", ["aspect"]).select(
        "aspect", F.col("company").alias("competitor"), S.half_even("_ours", 2).alias("primary_score"),
        S.half_even("_m", 2).alias("competitor_score"),
        S.half_even(F.col("_m") - F.col("_ours"), 2).alias("sentiment_gap"))


def summary_lookup(cells: DataFrame, summary: DataFrame, keys: Sequence[str], text: str = "analysis",
                   order: str = "row_id", default: str = "N/A") -> DataFrame:
    """Attach the first summary text for each cell, or the default."""
    first = summary.groupBy(*keys).agg(F.min_by(text, order).alias(text))
    return cells.join(first, list(keys), "left").withColumn(text, F.coalesce(text, F.lit(default)))


def available_aspects(aspects: DataFrame, df: DataFrame, column: str = "aspect") -> DataFrame:
    """Aspects of the dimension that occur in the data, in dimension order."""
    return aspects.join(df.select(column).distinct(), column, "left_semi").orderBy("ord")


def sides_with_reviews(reviews: DataFrame, primary: str, threshold: float = dims.EVIDENCE_WEIGHT,
                       weight: str = "review_weight") -> DataFrame:
    """``(competitor, product)`` pairs for which both companies have reviews of at least some weight."""
    sides = reviews.filter(F.col(weight) >= threshold).select("company", "product").distinct()
    ours = sides.filter(F.col("company") == primary).select("product")
    return sides.filter(F.col("company") != primary).join(ours, "product").select(F.col("company").alias("competitor"), "product")


def skipped_combinations(grid: DataFrame, kept: DataFrame, keys: Sequence[str], reviewed: DataFrame | None = None) -> DataFrame:
    """Cells of the grid that the comparison could not fill, and the ``reason``.

    A cell without a score on either side (it is not in ``kept``) is reported as that; of the others, a cell
    whose competitor and product are not in ``reviewed`` has no reviews to show as evidence.
    """
    scored = kept.select(*keys).distinct().withColumn("_scored", F.lit(True))
    cells = grid.join(scored, list(keys), "left")
    if reviewed is None:
        cells = cells.withColumn("_reviewed", F.lit(True))
    else:
        shared = [k for k in keys if k in reviewed.columns]
        cells = cells.join(reviewed.select(*shared).distinct().withColumn("_reviewed", F.lit(True)), shared, "left")
    reason = F.when(F.col("_scored").isNull(), "no score").when(F.col("_reviewed").isNull(), "no reviews")
    return cells.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_scored", "_reviewed")
