"""Queries over company comparisons."""

from pyspark.sql import functions as F

from voicegrid.operators import compare as M, rollups as U
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.plans.rollups import ASPECTS, each, tidy

P = V.PRIMARY
GRID_CTE = V.SA_CTE + f""", grid AS (
  SELECT c.company AS competitor, p.product, a.aspect
  FROM (SELECT DISTINCT company FROM sa WHERE company <> '{P}') c, (SELECT DISTINCT product FROM sa) p,
       (VALUES {each("('@')")}) a(aspect)),
latest AS (SELECT company, product, {each("arg_max({'v': @_sentiment_score}, month).v AS @")} FROM sa GROUP BY ALL),
last AS ({each("SELECT company, product, '@' AS aspect, @ AS score FROM latest", sep=" UNION ALL ")}),
gaps AS (SELECT t.company AS competitor, t.product, t.aspect, round_even(o.score - t.score, 2) AS sentiment_difference
  FROM last t JOIN last o ON o.company = '{P}' AND t.company <> '{P}' AND t.product = o.product AND t.aspect = o.aspect),
annual AS ({each("SELECT CAST(year(month) AS INTEGER) AS year, company, product, '@' AS aspect, avg(@_sentiment_score) "
                 "AS s FROM sa GROUP BY ALL HAVING avg(@_sentiment_score) IS NOT NULL", sep=" UNION ALL ")})"""


def _grid(body):
    return f"WITH {GRID_CTE} {body}"


@query("primary_vs_company_trend", V.sa_sql(f"""
SELECT month, round_even(avg(value_sentiment_score) FILTER (WHERE company = 'co2'), 12) AS company_score,
       round_even(avg(value_sentiment_score) FILTER (WHERE company = '{P}'), 12) AS primary_score
FROM sa WHERE company IN ('{P}', 'co2') GROUP BY month"""))
def primary_vs_company_trend(spark, sf):
    out = M.primary_vs_company_trend(V.sa_monthly(spark, sf), P, "co2", "value_sentiment_score")
    return tidy(out, "company_score", "primary_score")


@query("latest_gap", _grid("SELECT * FROM gaps"))
def latest_gap(spark, sf):
    return M.latest_gap(V.sa_monthly(spark, sf), P, ASPECTS)


def comparison_cells(spark, sf):
    years = V.scored(V.reviews(spark, sf)).select("year", "company", "product")
    return M.common_products(years, P).withColumn("aspect", F.explode(F.array(*[F.lit(a) for a in ASPECTS])))


@query("annual_gap", _grid(f"""
, cells AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS year, t.company AS competitor, t.product, a.aspect
  FROM reviews t, (VALUES {each("('@')")}) a(aspect) WHERE t.company <> '{P}'
  AND EXISTS (SELECT 1 FROM reviews o WHERE o.company = '{P}' AND o.product = t.product AND year(o.date) = year(t.date)))
SELECT c.year, c.competitor, c.product, c.aspect, round_even(o.s, 12) AS primary_score,
       round_even(t.s, 12) AS competitor_score, round_even(o.s - t.s, 12) AS sentiment_difference
FROM cells c LEFT JOIN annual o ON o.company = '{P}' AND (o.year, o.product, o.aspect) = (c.year, c.product, c.aspect)
LEFT JOIN annual t ON t.company = c.competitor AND (t.year, t.product, t.aspect) = (c.year, c.product, c.aspect)"""))
def annual_gap(spark, sf):
    scores = U.annual_aspect_scores(V.sa_monthly(spark, sf), ASPECTS)
    out = M.annual_gap(scores, comparison_cells(spark, sf), P)
    return tidy(out, "primary_score", "competitor_score", "sentiment_difference")


@query("comparison_grid", _grid("SELECT * FROM grid"))
def comparison_grid(spark, sf):
    return M.comparison_grid(V.reviews(spark, sf), P, ASPECTS)


@query("common_products", V.scored_sql(f"""
SELECT year, c.company AS competitor, product FROM (SELECT DISTINCT company FROM scored WHERE company <> '{P}') c,
LATERAL (SELECT year, product FROM scored WHERE company = c.company
         INTERSECT SELECT year, product FROM scored WHERE company = '{P}') i"""))
def common_products(spark, sf):
    return M.common_products(V.scored(V.reviews(spark, sf)), P)


@query("market_split", V.scored_sql(f"""
SELECT year, product, count(*) FILTER (WHERE company = '{P}') AS primary_reviews,
       count(*) FILTER (WHERE company <> '{P}') AS market_reviews,
       round_even(avg(score) FILTER (WHERE company = '{P}'), 12) AS primary_score,
       round_even(avg(score) FILTER (WHERE company <> '{P}'), 12) AS market_score
FROM scored GROUP BY year, product"""))
def market_split(spark, sf):
    return tidy(M.market_split(V.scored(V.reviews(spark, sf)), P, "score"), "primary_score", "market_score")


@query("best_competitor", V.sa_sql(f"""
, l AS ({each("SELECT '@' AS aspect, company, product, month, @_sentiment_score AS score FROM sa WHERE @_volume >= 3 "
              "AND @_sentiment_score IS NOT NULL", sep=" UNION ALL ")})
SELECT aspect, company, score FROM l
QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY score DESC, month, company, product) = 1"""))
def best_competitor(spark, sf):
    return M.best_competitor(V.sa_monthly(spark, sf), ASPECTS, 3)


@query("aspect_gap", V.sa_sql(f"""
, l AS ({each("SELECT company, '@' AS aspect, avg(@_sentiment_score) AS m FROM sa GROUP BY company", sep=" UNION ALL ")})
SELECT t.aspect, t.company AS competitor, {V.tie_safe('o.m', 2)} AS primary_score,
       {V.tie_safe('t.m', 2)} AS competitor_score, {V.tie_safe('t.m - o.m', 2)} AS sentiment_gap
FROM l t JOIN l o ON o.company = '{P}' AND t.company <> '{P}' AND t.aspect = o.aspect"""))
def aspect_gap(spark, sf):
    return M.aspect_gap(V.sa_monthly(spark, sf), P, ASPECTS)


@query("summary_lookup", _grid("""
, s AS (SELECT company, product, arg_min(md5(review), review_id) AS analysis FROM reviews WHERE score > 60 GROUP BY ALL)
SELECT competitor AS company, g.product, aspect, coalesce(analysis, 'Write up...') AS analysis
FROM grid g LEFT JOIN s ON s.company = g.competitor AND s.product = g.product"""))
def summary_lookup(spark, sf):
    cells = M.comparison_grid(V.reviews(spark, sf), P, ASPECTS).withColumnRenamed("competitor", "company")
    summary = V.reviews(spark, sf).filter("score > 60").select(
        "company", "product", F.md5("review").alias("analysis"), F.col("review_id").alias("row_id"))
    return M.summary_lookup(cells, summary, ["company", "product"], default="Write up...")


@query("available_aspects", V.ann_sql(f"""
SELECT aspect, ord FROM (VALUES ('speed', 0), ('value', 1), ('support', 2), ('absent', 3)) a(aspect, ord)
WHERE aspect IN ({each("SELECT '@' FROM ann WHERE w_@ > 0", sep=" UNION ")})"""))
def available_aspects(spark, sf):
    named = V.annotated(spark, sf).select(F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"w_{a}") > 0, F.lit(a)) for a in ASPECTS]))).alias("aspect"))
    dim = spark.createDataFrame([(a, i) for i, a in enumerate([*ASPECTS, "absent"])], "aspect string, ord int")
    return M.available_aspects(dim, named)


@query("skipped_combinations", _grid(f"""
, sides AS (SELECT DISTINCT company, product FROM ann WHERE review_weight >= 0.96 AND month >= DATE '2024-07-01'),
reviewed AS (SELECT t.company AS competitor, t.product FROM sides t JOIN sides o ON o.company = '{P}' AND t.company <> '{P}' AND o.product = t.product)
SELECT competitor, product, aspect, CASE WHEN g.sentiment_difference IS NULL THEN 'no score' ELSE 'no reviews' END AS reason
FROM grid LEFT JOIN (SELECT * FROM gaps WHERE sentiment_difference IS NOT NULL) g USING (competitor, product, aspect)
LEFT JOIN (SELECT *, true AS some FROM reviewed) r USING (competitor, product) WHERE g.sentiment_difference IS NULL OR r.some IS NULL"""))
def skipped_combinations(spark, sf):
    """Evidence is looked for in the second half of the year, so that some cells have none."""
    sa, keys = V.sa_monthly(spark, sf), ["competitor", "product", "aspect"]
    kept = M.latest_gap(sa, P, ASPECTS).filter(F.col("sentiment_difference").isNotNull())
    reviewed = M.sides_with_reviews(V.annotated(spark, sf).filter("month >= '2024-07-01'"), P)
    return M.skipped_combinations(M.comparison_grid(sa, P, ASPECTS), kept, keys, reviewed)
