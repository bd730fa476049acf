"""Aggregates and comparisons on handmade rows, including empty and single-row groups."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import compare as M, rollups as U

JAN, FEB = date(2024, 1, 1), date(2024, 2, 1)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (JAN, "A", "p", 0.5, 1, 0, "x"), (JAN, "A", "p", 1.0, 3, 0, "y"), (JAN, "B", "q", 0.2, 0, 0, None),
        (FEB, None, "p", 0.9, 1, 1, "z"), (FEB, "B", "p", 0.4, 2, 0, "w"),
    ], "month date, company string, product string, s double, w_bill int, w_app int, review string")


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_overall_rollup(rows):
    got = table(U.monthly_overall_rollup(rows, "s"), "month", "company", "product")
    assert len(got) == 3  # the row without a company is in no group
    assert (got[JAN, "A", "p"].reviews, got[JAN, "A", "p"].sentiment_score) == (2, 0.75)
    assert got[JAN, "B", "q"].sentiment_volatility is None  # one row has no deviation


def test_weighted_aspects(rows):
    got = table(U.weighted_monthly_aspect(rows, "s", ["bill", "app"], "review"), "month", "company", "product")
    assert got[JAN, "A", "p"].bill_sentiment_score == 87.5
    assert got[JAN, "B", "q"].bill_sentiment_score is None
    assert got[JAN, "A", "p"].app_sentiment_score is None
    assert got[JAN, "B", "q"].reviews == 0  # counts texts, not rows


def test_grid_has_every_cell(rows):
    got = table(U.weighted_aspect_grid(rows.dropna(subset=["company"]), "s", ["bill", "app"]), "company", "product", "aspect")
    assert len(got) == 2 * 2 * 2
    assert got["B", "p", "bill"].sentiment_score == 40.0
    assert got["A", "q", "bill"].sentiment_score is None


def test_one_pass_per_rollup(rows):
    plan = U.weighted_monthly_aspect(rows, "s", ["bill", "app"], "review")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_shares_sum_to_hundred(rows):
    got = U.share_of_known(rows, "company").collect()
    assert sum(r.pct for r in got) == 100
    assert {r.company: r.reviews for r in got} == {"A": 2, "B": 2}
    assert {r.company: r.pct for r in U.share_of(rows, "company").collect()} == {"A": 40.0, "B": 40.0}


def test_category_share_trend_has_no_row_for_absent_months(spark):
    df = spark.createDataFrame([(JAN, "a"), (JAN, "b"), (JAN, "b"), (FEB, "b")], "month date, c string")
    got = {(r.month, r.category): r.pct for r in U.category_share_trend(df, "c", ["a", "b", "never"]).collect()}
    assert got == {(JAN, "a"): 33.33, (JAN, "b"): 66.67, (FEB, "b"): 100.0}


def test_histogram_keeps_the_maximum(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert {r.bin: r.n for r in U.score_histogram(df, ["x"], 2).collect()} == {0: 1, 1: 2}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in U.score_histogram(flat, ["x"], 5).collect()] == [(0, 2)]


def test_numeric_contract(spark):
    df = spark.createDataFrame([(2.9, None, 1.25), (-2.9, 3, None)], "score double, volume int, volatility double")
    got = [tuple(r) for r in U.rollup_numeric_contract(df, ["score", "volume"], ["volatility"], F.lit(98.76)).collect()]
    assert got == [(2, 0, 1.2, 98.8), (-2, 3, 0.0, 98.8)]


def test_five_numbers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)] + [("b", None)], "k string, v double")
    r = U.score_distribution(df, "k", "v").collect()
    assert [tuple(x) for x in r] == [("a", 4, 1.0, 1.75, 2.5, 4.75, 10.0)]


def test_yearly_breakdown(spark):
    df = spark.range(1500).select(F.lit(JAN).alias("month")).union(spark.createDataFrame([(FEB,)], "month date"))
    assert [tuple(r) for r in U.yearly_breakdown(df).collect()] == [(2024, 1501, "1,500, 1")]


def test_threshold_rollup(spark):
    df = spark.createDataFrame([(JAN, "p", "A", r, s) for r, s in ((0.0, 1.0), (0.2, 2.0), (0.4, 4.0))],
                               "month date, product string, company string, relevance_x double, x_sentiment_score double")
    r = U.threshold_aspect_rollup(df, ["x"]).first()
    assert (r.x_sentiment_score, r.count_relevant_x) == (3.0, 2)


@pytest.fixture(scope="module")
def sa(spark):
    return spark.createDataFrame([
        (JAN, "P", "g", 10.0, 150, "5"), (FEB, "P", "g", 20.0, 150, "x"), (JAN, "C", "g", 90.0, 99, "7"),
        (FEB, "C", "g", 5.555, 120, None), (JAN, "D", "h", None, 500, "1"),
    ], "month date, company string, product string, fit_sentiment_score double, fit_volume int, raw_sentiment_score string")


def test_latest_gap(sa):
    assert [tuple(r) for r in M.latest_gap(sa, "P", ["fit"]).collect()] == [("C", "g", "fit", 14.44)]


def test_best_competitor(sa):
    assert M.best_competitor(sa, ["fit"]).first().company == "P"  # 90 has too few reviews
    assert M.best_competitor(sa, ["fit"], primary="P").first().company == "C"
    assert M.best_competitor(sa, ["fit"], min_volume=1).first().score == 90.0


def test_gap_is_rounded_after_subtracting(sa):
    r = {x.competitor: x for x in M.aspect_gap(sa, "P", ["fit"]).collect()}
    assert r["C"].sentiment_gap == 32.78
    assert r["D"].sentiment_gap is None


def test_annual_scores_drop_text(sa):
    got = {(r.company, r.aspect): r.sentiment_score for r in U.annual_aspect_scores(sa, ["fit", "raw"]).collect()}
    assert got == {("p", "fit"): 15.0, ("c", "fit"): pytest.approx(47.7775), ("p", "raw"): 5.0, ("c", "raw"): 7.0,
                   ("d", "raw"): 1.0}


def test_common_products_and_skipped(spark):
    df = spark.createDataFrame([(2024, "P", "a"), (2024, "P", "b"), (2024, "C", "a"), (2023, "C", "b"), (2024, "C", "c")],
                               "year int, company string, product string")
    assert [tuple(r) for r in M.common_products(df, "P").collect()] == [(2024, "C", "a")]
    grid = M.comparison_grid(df, "P", ["x"])
    kept = spark.createDataFrame([("C", "a", "x")], "competitor string, product string, aspect string")
    left = M.skipped_combinations(grid, kept, ["competitor", "product", "aspect"])
    assert sorted((r["product"], r.reason) for r in left.collect()) == [("b", "no score"), ("c", "no score")]
    reviews = spark.createDataFrame([("P", "a", 0.5), ("C", "a", 1.0), ("P", "b", 1.0), ("C", "b", 1.0), (None, "a", 1.0)],
                                    "company string, product string, review_weight double")
    reviewed = M.sides_with_reviews(reviews, "P")
    assert [tuple(r) for r in reviewed.collect()] == [("C", "b")]
    left = M.skipped_combinations(grid, kept, ["competitor", "product", "aspect"], reviewed)
    assert sorted((r["product"], r.reason) for r in left.collect()) == [("a", "no reviews"), ("b", "no score"), ("c", "no score")]


def test_summary_lookup(spark):
    cells = spark.createDataFrame([("A",), ("B",)], "company string")
    summary = spark.createDataFrame([("A", "second", 2), ("A", "first", 1)], "company string, analysis string, row_id int")
    got = dict(tuple(r) for r in M.summary_lookup(cells, summary, ["company"], default="none").collect())
    assert got == {"A": "first", "B": "none"}


def test_quartiles_of_close_values_are_exact(spark):
    df = spark.createDataFrame([("k", 0.12345), ("k", 0.12356), ("k", 0.12389)], "k string, v double")
    r = U.score_distribution(df, "k", "v").first()
    assert (r.minimum, r.median, r.maximum) == (0.12345, 0.12356, 0.12389)
