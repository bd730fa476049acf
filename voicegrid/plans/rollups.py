"""Queries over monthly rollups, trends, shares and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrid.functions import scores as S
from voicegrid.operators import rollups as U, textjobs as T
from voicegrid.plans import views as V
from voicegrid.plans.registry import query

ASPECTS, TOPICS = list(V.ASPECTS), list(V.TOPICS)


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Round away the binary noise that depends on the order of a sum: means to 12 places,
    deviations to 6."""
    return df.withColumns({c: S.half_even(F.col(c), 6 if "volatility" in c else 12) for c in columns})


def relevant(spark, sf) -> DataFrame:
    """Scored reviews with the token-set relevance of every aspect."""
    df = T.token_set(V.scored(V.reviews(spark, sf)), "review")
    return T.aspect_relevance(df, "tokens", V.ASPECTS).drop("tokens", "review")


REL_CTE = V.ANN_CTE + ", rel AS (SELECT *, " + ", ".join(
    f"CAST(len(list_intersect(list_distinct(toks), {V._list(w)})) AS INTEGER) AS relevance_{a}"
    for a, w in V.ASPECTS.items()) + " FROM ann)"


def each(template: str, names=ASPECTS, sep: str = ", ") -> str:
    return sep.join(template.replace("@", a) for a in names)


@query("monthly_overall_rollup", V.rev_sql("""
SELECT CAST(date_trunc('month', date) AS DATE) AS month, company, product, count(*) AS reviews,
       round_even(avg(score), 12) AS sentiment_score, round_even(stddev_samp(score), 6) AS sentiment_volatility
FROM reviews GROUP BY ALL"""))
def monthly_overall_rollup(spark, sf):
    df = V.scored(V.reviews(spark, sf))
    return tidy(U.monthly_overall_rollup(df, "score"), "sentiment_score", "sentiment_volatility")


ASPECT_STATS = each("round_even(avg(score) FILTER (WHERE relevance_@ >= 1), 12) AS @_sentiment_score, "
                    "round_even(stddev_samp(score) FILTER (WHERE relevance_@ >= 1), 6) AS @_volatility, "
                    "nullif(count(*) FILTER (WHERE relevance_@ >= 1), 0) AS @_volume")


def aspect_rollup(spark, sf):
    out = U.monthly_aspect_rollup(relevant(spark, sf), "score", ASPECTS)
    return tidy(out, "sentiment_score", "sentiment_volatility",
                *[f"{a}_{s}" for a in ASPECTS for s in ("sentiment_score", "volatility")])


ASPECT_ROLLUP_SQL = f"""
SELECT month, company, product, count(*) AS reviews, round_even(avg(score), 12) AS sentiment_score,
       round_even(stddev_samp(score), 6) AS sentiment_volatility, {ASPECT_STATS}
FROM rel GROUP BY ALL"""


@query("monthly_aspect_rollup", f"WITH {REL_CTE} {ASPECT_ROLLUP_SQL}")
def monthly_aspect_rollup(spark, sf):
    return aspect_rollup(spark, sf)


@query("rollup_numeric_contract", f"""WITH {REL_CTE}, r AS ({ASPECT_ROLLUP_SQL})
SELECT month, company, product, CAST(reviews AS INTEGER) AS reviews,
       CAST(trunc(coalesce(sentiment_score, 0)) AS INTEGER) AS sentiment_score,
       CAST(trunc(coalesce(sentiment_volatility, 0)) AS INTEGER) AS sentiment_volatility,
       {each("round_even(coalesce(@_sentiment_score, 0), 1) AS @_sentiment_score, "
             "round_even(coalesce(@_volatility, 0), 1) AS @_volatility, "
             "CAST(coalesce(@_volume, 0) AS INTEGER) AS @_volume")}, 98.8::DOUBLE AS data_quality_score FROM r""")
def rollup_numeric_contract(spark, sf):
    volumes = [f"{a}_volume" for a in ASPECTS]
    return U.rollup_numeric_contract(
        aspect_rollup(spark, sf), ["reviews", "sentiment_score", "sentiment_volatility", *volumes],
        [f"{a}_{s}" for a in ASPECTS for s in ("sentiment_score", "volatility")], F.lit(98.76))


@query("monthly_product_company_stats", V.rev_sql("""
SELECT CAST(date_trunc('month', date) AS DATE) AS month, product, company, count(review) AS total_reviews,
       round_even(avg(score), 12) AS sentiment_score FROM reviews GROUP BY ALL"""))
def monthly_product_company_stats(spark, sf):
    df = V.scored(V.reviews(spark, sf))
    return tidy(U.monthly_product_company_stats(df, "review", "score"), "sentiment_score")


SHARE_CTE = REL_CTE + f""", share AS (
  SELECT *, {each("CASE WHEN top > 0 THEN sentiment * (relevance_@ / CAST(top AS DOUBLE)) ELSE 0.0 END "
                  "AS @_sentiment_score")}
  FROM (SELECT *, greatest({each("relevance_@")}) AS top FROM rel))"""


def shared(spark, sf) -> DataFrame:
    return T.relevance_share_sentiment(relevant(spark, sf), "sentiment", ASPECTS)


@query("relevance_share_sentiment", f"""WITH {SHARE_CTE}
SELECT review_id, {each("round_even(@_sentiment_score, 12) AS @_sentiment_score")} FROM share""")
def relevance_share_sentiment(spark, sf):
    cols = [f"{a}_sentiment_score" for a in ASPECTS]
    return tidy(shared(spark, sf).select("review_id", *cols), *cols)


@query("aspect_median_threshold", f"""WITH {REL_CTE}
SELECT {each("CAST(median(relevance_@) AS DOUBLE) AS median_@")} FROM rel""")
def aspect_median_threshold(spark, sf):
    return U.aspect_median_threshold(relevant(spark, sf), ASPECTS)


@query("threshold_aspect_rollup", f"""WITH {SHARE_CTE}, m AS (
  SELECT {each("median(relevance_@) AS m_@")} FROM rel)
SELECT month, product, company,
       {each("round_even(avg(@_sentiment_score) FILTER (WHERE relevance_@ >= m_@), 12) AS @_sentiment_score, "
             "count(*) FILTER (WHERE relevance_@ >= m_@) AS count_relevant_@")}
FROM share, m GROUP BY ALL""")
def threshold_aspect_rollup(spark, sf):
    return tidy(U.threshold_aspect_rollup(shared(spark, sf), ASPECTS), *[f"{a}_sentiment_score" for a in ASPECTS])


@query("monthly_category_rollup", V.ann_sql("""
SELECT month, category, company, CAST(round_even(avg(score), 0) AS INTEGER) AS sentiment_score,
       count(*) AS reviews_count FROM ann GROUP BY ALL"""))
def monthly_category_rollup(spark, sf):
    return U.monthly_category_rollup(V.annotated(spark, sf), "category", "score")


@query("monthly_base_sentiment", V.rev_sql("""
SELECT CAST(date_trunc('month', date) AS DATE) AS month, company, product,
       round_even(avg(score), 0) AS sentiment_score, count(review) AS reviews FROM reviews GROUP BY ALL"""))
def monthly_base_sentiment(spark, sf):
    return U.monthly_base_sentiment(V.scored(V.reviews(spark, sf)), "score", "review", scale=1)


@query("weighted_monthly_aspect", V.ann_sql(f"""
SELECT month, company, product, round_even(avg(score), 0) AS sentiment_score, count(review) AS reviews,
       {each("round_even(CAST(sum(score * w_@) AS DOUBLE) / nullif(sum(w_@), 0), 1) AS @_sentiment_score")}
FROM ann GROUP BY ALL"""))
def weighted_monthly_aspect(spark, sf):
    return U.weighted_monthly_aspect(V.annotated(spark, sf), "score", ASPECTS, "review", scale=1)


@query("weighted_aspect_grid", V.ann_sql(f"""
, c AS (SELECT DISTINCT company FROM ann), p AS (SELECT DISTINCT product FROM ann),
g AS ({each("SELECT company, product, '@' AS aspect, round_even(CAST(sum(score * w_@) AS DOUBLE) "
            "/ nullif(sum(w_@), 0), 1) AS sentiment_score FROM ann GROUP BY company, product", sep=" UNION ALL ")}),
a(aspect) AS (VALUES {each("('@')")})
SELECT company, product, aspect, sentiment_score
FROM c CROSS JOIN p CROSS JOIN a LEFT JOIN g USING (company, product, aspect)"""))
def weighted_aspect_grid(spark, sf):
    return U.weighted_aspect_grid(V.annotated(spark, sf), "score", ASPECTS, scale=1)


@query("market_grid", V.rev_sql("""
SELECT y.year, p.product, a.aspect, 'AI Gen Summary Here...' AS analysis
FROM (SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM reviews) y,
     (VALUES ('Electricity'), ('Gas Supply')) p(product), (VALUES ('Net Zero'), ('Service')) a(aspect)"""))
def market_grid(spark, sf):
    return U.market_grid(V.reviews(spark, sf), "date", ["Electricity", "Gas Supply"], ["Net Zero", "Service"])


# -- trends -------------------------------------------------------------------------------


@query("company_trend", V.sa_sql("""
SELECT month, round_even(avg(sentiment_score), 12) AS sentiment_score FROM sa
WHERE company = 'co1' AND product = 'en' GROUP BY month"""))
def company_trend(spark, sf):
    df = V.sa_monthly(spark, sf).filter("company = 'co1' AND product = 'en'")
    return tidy(U.trend(df, ["month"], "sentiment_score"), "sentiment_score")


@query("product_trend", V.sa_sql("""
SELECT month, product, round_even(avg(value_sentiment_score), 12) AS value_sentiment_score FROM sa
WHERE company = 'co1' GROUP BY month, product"""))
def product_trend(spark, sf):
    df = V.sa_monthly(spark, sf).filter("company = 'co1'")
    return tidy(U.trend(df, ["month", "product"], "value_sentiment_score"), "value_sentiment_score")


@query("aspect_trend_long", V.sa_sql(each(
    "SELECT month, company, '@' AS aspect, @_sentiment_score AS sentiment_score FROM sa WHERE product = 'en'",
    sep=" UNION ALL ")))
def aspect_trend_long(spark, sf):
    df = V.sa_monthly(spark, sf).filter("product = 'en'")
    return U.aspect_trend_long(df, ["month", "company"], ASPECTS)


@query("market_aspect_trend", V.sa_sql("""
SELECT month, company, round_even(avg(speed_sentiment_score), 12) AS speed_sentiment_score FROM sa
WHERE contains(product, 'en') GROUP BY month, company"""))
def market_aspect_trend(spark, sf):
    df = V.sa_monthly(spark, sf).filter(F.col("product").rlike("en"))
    return tidy(U.trend(df, ["month", "company"], "speed_sentiment_score"), "speed_sentiment_score")


@query("market_overall_trend", V.rev_sql("""
, m AS (SELECT date_trunc('month', date) AS m, company, product, round_even(avg(score), 1) AS s FROM reviews GROUP BY ALL)
SELECT CAST(m AS DATE) AS month, product, company, round_even(avg(s), 12) AS sentiment_score FROM m GROUP BY ALL"""))
def market_overall_trend(spark, sf):
    return tidy(U.trend(V.sa_monthly(spark, sf), ["month", "product", "company"], "sentiment_score"), "sentiment_score")


@query("score_distribution", V.rev_sql("""
SELECT company, count(*) AS n, CAST(min(score) AS DOUBLE) AS minimum, quantile_cont(score, 0.25) AS q1,
       quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, CAST(max(score) AS DOUBLE) AS maximum
FROM reviews GROUP BY company"""))
def score_distribution(spark, sf):
    return U.score_distribution(V.reviews(spark, sf), "company", "score")


@query("aspect_mean_truncated", V.sa_sql("""
SELECT company, product, CAST(trunc(avg(support_sentiment_score)) AS INTEGER) AS support_sentiment_score
FROM sa GROUP BY company, product"""))
def aspect_mean_truncated(spark, sf):
    return U.aspect_mean_truncated(V.sa_monthly(spark, sf), ["company", "product"], "support_sentiment_score")


@query("monthly_volume", V.scored_sql("SELECT month, count(*) AS reviews FROM scored GROUP BY month"))
def monthly_volume(spark, sf):
    return U.volume(V.scored(V.reviews(spark, sf)), "month")


@query("monthly_volume_by_company", V.scored_sql("""
SELECT month, company, count(*) AS reviews FROM scored GROUP BY month, company"""))
def monthly_volume_by_company(spark, sf):
    return U.volume(V.scored(V.reviews(spark, sf)), "month", "company")


@query("share_of_voice", """
SELECT n_name AS nation, count(*) AS reviews,
       round_even(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) * 100, 0) AS pct
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def share_of_voice(spark, sf):
    """Order share by customer nation: the share of a fact table by a name two lookups away."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return U.share_of(orders.select(F.col("n_name").alias("nation")), "nation")


@query("share_of_voice_by_company", V.rev_sql("""
SELECT company, count(*) AS reviews, round_even(count(*) / CAST((SELECT count(*) FROM reviews) AS DOUBLE) * 100, 0)
       AS pct FROM reviews GROUP BY company"""))
def share_of_voice_by_company(spark, sf):
    return U.share_of(V.reviews(spark, sf), "company")


@query("length_mix", V.ann_sql("""
SELECT length_cat, count(*) AS reviews, round_even(count(*) / CAST((SELECT count(*) FROM ann) AS DOUBLE) * 100, 0)
       AS pct FROM ann GROUP BY length_cat"""))
def length_mix(spark, sf):
    return U.share_of_known(V.annotated(spark, sf), "length_cat")


SHARE_TRENDS = {"payment_method": ["Direct Debit", "Prepayment Meter"], "fuel_type": ["Gas Supply", "Electricity"],
                "tariff_type": ["Fixed", "Variable"], "switching": ["Intent", "Outcome"]}
SHARE_TREND_SQL = " UNION ALL ".join(
    f"SELECT month, '{v}' AS category, round_even(count(*) FILTER (WHERE {c} = '{v}') / CAST(count(*) AS DOUBLE) "
    f"* 100, 2) AS pct FROM ann GROUP BY month HAVING count(*) FILTER (WHERE {c} = '{v}') > 0"
    for c, vs in SHARE_TRENDS.items() for v in vs)


@query("category_share_trend", V.ann_sql(SHARE_TREND_SQL.split(" UNION ALL ")[0] + " UNION ALL "
                                         + SHARE_TREND_SQL.split(" UNION ALL ")[1]))
def category_share_trend(spark, sf):
    return U.category_share_trend(V.annotated(spark, sf), "payment_method", SHARE_TRENDS["payment_method"])


@query("concat_category_trends", V.ann_sql(SHARE_TREND_SQL))
def concat_category_trends(spark, sf):
    return U.concat_category_trends(V.annotated(spark, sf), SHARE_TRENDS)


@query("flag_share_trend", V.ann_sql("""
SELECT month, count(*) FILTER (WHERE reg_ref_flag = 1) AS n, count(*) AS reviews,
       round_even(count(*) FILTER (WHERE reg_ref_flag = 1) / CAST(count(*) AS DOUBLE) * 100, 2) AS pct
FROM ann GROUP BY month HAVING count(*) FILTER (WHERE reg_ref_flag = 1) > 0"""))
def flag_share_trend(spark, sf):
    return U.flag_share_trend(V.annotated(spark, sf), "reg_ref_flag")


@query("sentiment_trend_by_company", V.scored_sql("""
SELECT month, company, round_even(avg(sent_n), 12) AS sent_n, round_even(avg(tone_n), 12) AS tone_n
FROM scored GROUP BY month, company"""))
def sentiment_trend_by_company(spark, sf):
    df = V.scored(V.reviews(spark, sf))
    return U.group_means(df, ["month", "company"], {"sent_n": "sent_n", "tone_n": "tone_n"}, 12)


@query("quality_trend_by_company", V.ann_sql("""
SELECT month, company, round_even(avg(quality_score), 12) AS quality_score FROM ann GROUP BY month, company"""))
def quality_trend_by_company(spark, sf):
    return tidy(U.trend(V.annotated(spark, sf), ["month", "company"], "quality_score"), "quality_score")


@query("company_scorecard", V.ann_sql("""
SELECT company, round_even(avg(sent_n), 12) AS avg_sentiment, round_even(avg(quality_score), 12) AS avg_quality,
       count(*) AS reviews FROM ann GROUP BY company"""))
def company_scorecard(spark, sf):
    return tidy(U.company_scorecard(V.annotated(spark, sf), "sent_n", "quality_score"), "avg_sentiment", "avg_quality")


def with_tfidf(spark, sf) -> DataFrame:
    """Annotated reviews with topic TF-IDF."""
    return T.with_topic_scores(V.annotated(spark, sf), "review", V.TOPICS)


TFIDF_CTE = V.ANN_CTE + f""", vocab(topic, term) AS (VALUES {", ".join(
    f"('{k}', '{t}')" for k, ts in V.TOPICS.items() for t in ts)}),
hit AS (SELECT review_id, unnest(toks) AS term FROM ann),
tf AS (SELECT review_id, topic, term, count(*) AS tf FROM hit JOIN vocab USING (term) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM ann)) / (1 + CAST(count(*) AS DOUBLE))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT review_id, topic, tf * idf AS w FROM tf JOIN idf USING (term)),
sums AS (SELECT review_id, sqrt(sum(w * w)) AS norm,
         {each("sum(w) FILTER (WHERE topic = '@') AS s_@", TOPICS)} FROM w GROUP BY review_id),
tfidf AS (SELECT review_id, {each("round_even(coalesce(s_@ / norm, 0), 3) AS tfidf_@", TOPICS)}
          FROM ann LEFT JOIN sums USING (review_id))"""


@query("tfidf_topic_score", f"WITH {TFIDF_CTE} SELECT * FROM tfidf")
def tfidf_topic_score(spark, sf):
    return T.tfidf_topic_score(V.reviews(spark, sf), "review_id", "review", V.TOPICS)


@query("topic_averages", f"""WITH {TFIDF_CTE}, a AS (SELECT * FROM ann JOIN tfidf USING (review_id))
{each("SELECT '@' AS topic, 'avg_kw' AS metric, round_even(avg(kw_@), 2) AS value FROM a", TOPICS, " UNION ALL ")}
UNION ALL {each("SELECT '@', 'avg_tfidf', round_even(avg(tfidf_@), 3) FROM a", TOPICS, " UNION ALL ")}""")
def topic_averages(spark, sf):
    return U.topic_averages(with_tfidf(spark, sf), TOPICS)


@query("topic_trend_kw", V.ann_sql(f"""
SELECT month, {each("round_even(avg(kw_@), 12) AS kw_@", TOPICS)} FROM ann GROUP BY month"""))
def topic_trend_kw(spark, sf):
    return U.group_means(V.annotated(spark, sf), ["month"], {f"kw_{t}": f"kw_{t}" for t in TOPICS}, 12)


@query("topic_trend_tfidf", f"""WITH {TFIDF_CTE}
SELECT month, {each("round_even(avg(tfidf_@), 12) AS tfidf_@", TOPICS)}
FROM ann JOIN tfidf USING (review_id) GROUP BY month""")
def topic_trend_tfidf(spark, sf):
    return U.group_means(with_tfidf(spark, sf), ["month"], {f"tfidf_{t}": f"tfidf_{t}" for t in TOPICS}, 12)


@query("green_trend", V.ann_sql("""
SELECT month, company, round_even(avg(kw_green), 12) AS kw_green FROM ann GROUP BY month, company
UNION ALL SELECT month, 'all', round_even(avg(kw_green), 12) FROM ann GROUP BY month"""))
def green_trend(spark, sf):
    return tidy(U.trend_with_total(V.annotated(spark, sf), "kw_green"), "kw_green")


@query("topic_sentiment_trend", V.ann_sql("""
SELECT month, company, round_even(avg(sent_n), 12) AS sent_n FROM ann WHERE kw_green > 0 GROUP BY month, company"""))
def topic_sentiment_trend(spark, sf):
    return tidy(U.topic_sentiment_trend(V.annotated(spark, sf), "kw_green", "sent_n"), "sent_n")


# -- distributions and summaries --------------------------------------------------------------


@query("score_histogram", V.rev_sql("""
, l AS (SELECT 'score' AS method, score FROM reviews
        UNION ALL SELECT 'rank_score', CAST((review_id * 53) % 201 AS INTEGER) - 100 FROM reviews),
s AS (SELECT min(score) AS lo, max(score) AS hi FROM l)
SELECT method, CAST(least(floor((score - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS bin, count(*) AS n
FROM l, s GROUP BY ALL"""))
def score_histogram(spark, sf):
    second = ((F.col("review_id") * 53) % 201).cast("int") - 100
    df = V.reviews(spark, sf).select("score", second.alias("rank_score"))
    return U.score_histogram(df, ["score", "rank_score"], 50)


@query("polarity_split", V.scored_sql(" UNION ALL ".join(
    f"""SELECT '{m}' AS method, positive, neutral, negative, round_even(positive / n * 100, 0) AS positive_pct,
        round_even(neutral / n * 100, 0) AS neutral_pct, round_even(negative / n * 100, 0) AS negative_pct
        FROM (SELECT count(*) FILTER (WHERE {m} > 0) AS positive, count(*) FILTER (WHERE {m} = 0) AS neutral,
                     count(*) FILTER (WHERE {m} < 0) AS negative, CAST(count(*) AS DOUBLE) AS n FROM scored)"""
    for m in ("sentiment", "tone"))))
def polarity_split(spark, sf):
    return U.polarity_split(V.scored(V.reviews(spark, sf)), ["sentiment", "tone"])


SUMMARY_COLUMNS = ["length_cat", "payment_method", "fuel_type", "tariff_type", "switching"]


@query("category_summary", V.ann_sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS category, {c} AS value, count(*) AS n,
        round_even(count(*) / CAST((SELECT count(*) FROM ann) AS DOUBLE) * 100, 0) AS pct FROM ann GROUP BY {c}"""
    for c in SUMMARY_COLUMNS)))
def category_summary(spark, sf):
    return U.category_summary(V.annotated(spark, sf), SUMMARY_COLUMNS)


FLAGS = ["justification", "promo_flag", "reg_ref_flag", "smart_meter_flag", *[f"channel_{c}" for c in V.CHANNELS]]


@query("flag_summary", V.ann_sql(" UNION ALL ".join(
    f"""SELECT '{f}' AS flag, CAST(sum({f}) AS BIGINT) AS n,
        round_even(CAST(sum({f}) AS DOUBLE) / count(*) * 100, 0) AS pct FROM ann""" for f in FLAGS)))
def flag_summary(spark, sf):
    return U.flag_summary(V.annotated(spark, sf), FLAGS)


@query("quality_describe", V.ann_sql("""
SELECT count(quality_score) AS count, round_even(avg(quality_score), 3) AS mean,
       round_even(stddev_samp(quality_score), 3) AS std, min(quality_score) AS min,
       round_even(quantile_cont(quality_score, 0.25), 3) AS p25, round_even(quantile_cont(quality_score, 0.5), 3) AS p50,
       round_even(quantile_cont(quality_score, 0.75), 3) AS p75, max(quality_score) AS max FROM ann"""))
def quality_describe(spark, sf):
    return U.describe(V.annotated(spark, sf), "quality_score")


MEAN_COLUMNS = ["length_score", "sent_n", "tone_n"]


@query("corpus_means", V.ann_sql(each(
    "SELECT '@' AS metric, round_even(avg(@), 3) AS value FROM ann", MEAN_COLUMNS, " UNION ALL ")))
def corpus_means(spark, sf):
    return U.corpus_means(V.annotated(spark, sf), MEAN_COLUMNS)


@query("yearly_breakdown", V.scored_sql("""
, m AS (SELECT year, month, count(*) AS n FROM scored GROUP BY ALL)
SELECT year, CAST(sum(n) AS BIGINT) AS reviews, string_agg(format('{:,}', n), ', ' ORDER BY month) AS monthly
FROM m GROUP BY year"""))
def yearly_breakdown(spark, sf):
    return U.yearly_breakdown(V.scored(V.reviews(spark, sf)))


@query("company_top5", V.rev_sql("""
, c AS (SELECT company, count(*) AS reviews FROM reviews GROUP BY company)
SELECT company, reviews, round_even(reviews / CAST((SELECT sum(reviews) FROM c) AS DOUBLE) * 100, 0) AS pct,
       (SELECT count(*) FROM c) AS companies, (SELECT string_agg(company, ', ' ORDER BY company) FROM c) AS names
FROM c ORDER BY reviews DESC, company LIMIT 5"""))
def company_top5(spark, sf):
    return U.company_top(V.reviews(spark, sf), 5)


@query("annual_aspect_scores", V.sa_sql(f"""
, l AS ({each("SELECT CAST(year(month) AS INTEGER) AS year, lower(trim(company)) AS company, lower(trim(product)) "
              "AS product, '@' AS aspect, TRY_CAST(CASE WHEN month(month) = 3 THEN 'n/a' ELSE "
              "CAST(@_sentiment_score AS VARCHAR) END AS DOUBLE) AS s FROM sa", sep=" UNION ALL ")})
SELECT year, company, product, aspect, round_even(avg(s), 12) AS sentiment_score FROM l WHERE s IS NOT NULL GROUP BY ALL"""))
def annual_aspect_scores(spark, sf):
    text = {f"{a}_sentiment_score": F.when(F.month("month") == 3, "n/a").otherwise(
        F.col(f"{a}_sentiment_score").cast("string")) for a in ASPECTS}
    df = V.sa_monthly(spark, sf).withColumns(text)
    return tidy(U.annual_aspect_scores(df, ASPECTS), "sentiment_score")


@query("evidence_audit_grid", V.ann_sql("""
, c AS (SELECT DISTINCT company FROM ann), p AS (SELECT DISTINCT product FROM ann),
n AS (SELECT company, product, count(*) AS t, count(*) FILTER (WHERE review_weight >= 0.89) AS h FROM ann GROUP BY ALL)
SELECT company, product, coalesce(t, 0) AS total_reviews, coalesce(h, 0) AS above_threshold,
       least(coalesce(h, 0), 20) AS usable FROM c CROSS JOIN p LEFT JOIN n USING (company, product)"""))
def evidence_audit_grid(spark, sf):
    return U.evidence_audit_grid(V.annotated(spark, sf), "review_weight", 0.89, 20)
