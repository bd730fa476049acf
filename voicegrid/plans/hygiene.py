"""Queries over filters and hygiene steps."""

from datetime import date

from pyspark.sql import functions as F

from voicegrid.operators import clean as C
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.plans.sources import DATE_TEXT_CTE, date_texts

HOLED_CTE = V.REVIEWS_CTE + r""", holed AS (
  SELECT * REPLACE (CASE WHEN review_id % 9 = 0 THEN NULL ELSE company END AS company,
                    CASE review_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN 'fourteen chars'
                                       WHEN 3 THEN 'fifteen charact' ELSE review END AS review)
  FROM reviews)"""


def holed(spark, sf):
    """Reviews with missing companies and with missing, blank and very short texts."""
    k, t = F.col("review_id"), F.col("review")
    text = (F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, "   ")
            .when(k % 7 == 2, "fourteen chars").when(k % 7 == 3, "fifteen charact").otherwise(t))
    return V.reviews(spark, sf).withColumns({
        "company": F.when(k % 9 != 0, F.col("company")), "review": text})


def _holed(body):
    return f"WITH {HOLED_CTE} {body}"


@query("drop_null_essential", _holed("""
SELECT review_id, company FROM holed WHERE company IS NOT NULL AND review IS NOT NULL"""))
def drop_null_essential(spark, sf):
    return C.drop_null_essential(holed(spark, sf), ["company", "review"]).select("review_id", "company")


@query("drop_blank_text", _holed("SELECT review_id FROM holed WHERE length(trim(review)) > 0"))
def drop_blank_text(spark, sf):
    return C.drop_blank_text(holed(spark, sf), "review").select("review_id")


@query("drop_invalid_dates", f"""WITH {DATE_TEXT_CTE}
SELECT review_id, parsed AS date FROM dated WHERE parsed IS NOT NULL""")
def drop_invalid_dates(spark, sf):
    return C.drop_invalid_dates(date_texts(V.reviews(spark, sf)), "date_text", "date").select("review_id", "date")


@query("min_length_filter", _holed("SELECT review_id FROM holed WHERE length(coalesce(review, '')) >= 15"))
def min_length_filter(spark, sf):
    return C.min_length_filter(holed(spark, sf), "review").select("review_id")


@query("dedup_exact_keep_first", V.rev_sql("""
SELECT review_id, company, md5(review) AS digest FROM reviews
QUALIFY row_number() OVER (PARTITION BY review ORDER BY review_id) = 1"""))
def dedup_exact_keep_first(spark, sf):
    out = C.dedup_exact_keep_first(V.reviews(spark, sf), "review", "review_id")
    return out.select("review_id", "company", F.md5("review").alias("digest"))


@query("data_quality_report", f"""WITH {HOLED_CTE}, d AS (
  SELECT review, CASE WHEN review_id % 6 < 4 THEN date END AS parsed FROM holed),
c AS (SELECT count(*) AS loaded, count(*) FILTER (WHERE parsed IS NULL) AS invalid_date,
             count(*) FILTER (WHERE parsed IS NOT NULL AND length(coalesce(review, '')) < 15) AS too_short FROM d)
SELECT *, loaded - invalid_date - too_short AS kept,
       round_even((loaded - invalid_date - too_short) / CAST(loaded AS DOUBLE) * 100, 1) AS quality_pct FROM c""")
def data_quality_report(spark, sf):
    return C.data_quality_report(date_texts(holed(spark, sf)), "date_text", "review")


@query("year_filter", V.rev_sql("SELECT review_id, date FROM reviews WHERE year(date) = 2024"))
def year_filter(spark, sf):
    return C.year_filter(V.reviews(spark, sf), "date", 2024).select("review_id", "date")


@query("date_range_filter", V.rev_sql("""
SELECT review_id, date FROM reviews, (SELECT min(date) AS lo, max(date) AS hi FROM reviews)
WHERE date BETWEEN greatest(lo, DATE '2023-01-01') AND least(hi, DATE '2024-06-30')"""))
def date_range_filter(spark, sf):
    return C.date_range_filter(V.reviews(spark, sf), "date", date(2023, 1, 1), date(2024, 6, 30)).select("review_id", "date")


@query("provider_in_filter", V.rev_sql("""
SELECT company, count(*) AS n FROM reviews WHERE company IN ('co0', 'co2', 'co9') GROUP BY company"""))
def provider_in_filter(spark, sf):
    return C.provider_in_filter(V.reviews(spark, sf), "company", ["co0", "co2", "co9"]).groupBy("company").agg(
        F.count("*").alias("n"))


@query("company_product_filter", V.rev_sql("""
SELECT review_id, score FROM reviews WHERE company = 'co1' AND product = 'fr'"""))
def company_product_filter(spark, sf):
    return C.company_product_filter(V.reviews(spark, sf), "co1", "fr").select("review_id", "score")


@query("regex_contains_filter", V.rev_sql("""
SELECT review_id, company FROM reviews WHERE regexp_matches(company, 'o[1-3]')"""))
def regex_contains_filter(spark, sf):
    df = C.regex_contains_filter(V.reviews(spark, sf), "product", None)
    return C.regex_contains_filter(df, "company", "o[1-3]").select("review_id", "company")


@query("exclude_unknown", V.ann_sql("SELECT review_id, fuel_type FROM ann WHERE fuel_type <> 'Unknown'"))
def exclude_unknown(spark, sf):
    return C.exclude_unknown(V.annotated(spark, sf), "fuel_type").select("review_id", "fuel_type")


@query("weight_threshold_filter", V.ann_sql("""
SELECT review_id, review_weight FROM ann WHERE review_weight >= 0.89"""))
def weight_threshold_filter(spark, sf):
    return C.weight_threshold_filter(V.annotated(spark, sf), threshold=0.89).select("review_id", "review_weight")


@query("mention_filter", V.rev_sql("""
SELECT review_id FROM reviews WHERE contains(lower(review), 'tion th') OR contains(lower(review), 'ingin')"""))
def mention_filter(spark, sf):
    return C.mention_filter(V.reviews(spark, sf), "review", ["Tion th", "ingin"]).select("review_id")


@query("head_sample", V.rev_sql("SELECT review_id, company FROM reviews ORDER BY review_id LIMIT 10"))
def head_sample(spark, sf):
    return C.head_sample(V.reviews(spark, sf), "review_id", 10).select("review_id", "company")


@query("distinct_options", V.rev_sql("SELECT DISTINCT company, product FROM reviews"))
def distinct_options(spark, sf):
    return C.distinct_options(V.reviews(spark, sf), "company", "product")
