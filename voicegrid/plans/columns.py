"""Queries over derived columns."""

from pyspark.sql import functions as F

from voicegrid import dims
from voicegrid.functions import dates as D, labels as L, scores as S, words as W
from voicegrid.operators import annotate as A
from voicegrid.plans import views as V
from voicegrid.plans.hygiene import HOLED_CTE, holed
from voicegrid.plans.registry import query


def _annotated_columns(name, *columns):
    """Register a query that shows annotated columns next to the review key."""
    @query(name, V.ann_sql(f"SELECT review_id, {', '.join(columns)} FROM ann"))
    def run(spark, sf):
        return V.annotated(spark, sf).select("review_id", *columns)
    return run


@query("month_bucket", V.rev_sql(r"""
SELECT review_id, CAST(date_trunc('month', date) AS DATE) AS month, strftime(date, '%Y-%m') AS month_text
FROM reviews"""))
def month_bucket(spark, sf):
    d = F.col("date")
    return V.reviews(spark, sf).select("review_id", D.month_start(d).alias("month"), D.month_text(d).alias("month_text"))


@query("year_extract", V.rev_sql("SELECT review_id, CAST(year(date) AS INTEGER) AS year FROM reviews"))
def year_extract(spark, sf):
    return V.reviews(spark, sf).select("review_id", F.year("date").alias("year"))


SPELLED_CTE = V.REVIEWS_CTE + r""", spelled AS (
  SELECT * REPLACE (CASE review_id % 3 WHEN 0 THEN ' ' || company WHEN 1 THEN upper(company)
                                       ELSE company || ' ' END AS company) FROM reviews)"""


def spelled(spark, sf):
    """Reviews whose company names vary in case and blanks."""
    k, c = F.col("review_id") % 3, F.col("company")
    return V.reviews(spark, sf).withColumn("company", F.when(k == 0, F.concat(F.lit(" "), c)).when(
        k == 1, F.upper(c)).otherwise(F.concat(c, F.lit(" "))))


@query("match_keys", f"""WITH {SPELLED_CTE}
SELECT review_id, lower(trim(company)) AS company_key, lower(trim(product)) AS product_key FROM spelled""")
def match_keys(spark, sf):
    return A.match_keys(spelled(spark, sf), "company", "product").select("review_id", "company_key", "product_key")


@query("canonical_spelling", f"""WITH {SPELLED_CTE}
SELECT review_id, first_value(company) OVER (PARTITION BY lower(trim(company)) ORDER BY review_id) AS company
FROM spelled""")
def canonical_spelling(spark, sf):
    return A.canonical_spelling(spelled(spark, sf), "company", "review_id").select("review_id", "company")


@query("char_length", f"WITH {HOLED_CTE} SELECT review_id, length(coalesce(review, '')) AS chars FROM holed")
def char_length(spark, sf):
    return holed(spark, sf).select("review_id", F.length(F.coalesce("review", F.lit(""))).cast("bigint").alias("chars"))


@query("word_count", rf"""WITH {HOLED_CTE}
SELECT review_id, CAST(len(list_filter(regexp_split_to_array(coalesce(review, ''), '[\s\p{{Z}}]+'),
                                       lambda w: w <> '')) AS INTEGER) AS word_count FROM holed""")
def word_count(spark, sf):
    return holed(spark, sf).select("review_id", F.size(W.chunks(F.col("review"))).alias("word_count"))


_annotated_columns("length_bucket", "length_cat")
_annotated_columns("length_score", "length_score")
_annotated_columns("payment_method", "payment_method")
_annotated_columns("fuel_type", "fuel_type")
_annotated_columns("tariff_type", "tariff_type")
_annotated_columns("switching_stage", "switching")
_annotated_columns("smart_meter_flag", "smart_meter_flag")
_annotated_columns("promo_flag", "promo_flag")
_annotated_columns("channel_flags", *[f"channel_{c}" for c in V.CHANNELS])
_annotated_columns("regulatory_flag", "reg_ref_flag")
_annotated_columns("category_first_match", "category")
_annotated_columns("quality_score", "quality_score")


@query("justification_flag", V.ann_sql(f"""
SELECT review_id, list_has_any(toks, {V._list(dims.REASON_TERMS[:3])}) OR {V._phrase(dims.REASON_TERMS[3:])}
       AS justified, list_has_any(toks, ['as', 'that']) AS justified_short FROM ann"""))
def justification_flag(spark, sf):
    df = V.reviews(spark, sf)
    return df.select("review_id", L.justification(F.col("review")).alias("justified"),
                     L.justification(F.col("review"), ["as", "that"]).alias("justified_short"))


@query("risk_flags", V.ann_sql("""
SELECT review_id, CAST(kw_green > 0 AS INTEGER) AS green_flag,
       CAST(switching IN ('Intent', 'Outcome') AS INTEGER) AS switch_flag FROM ann"""))
def risk_flags(spark, sf):
    return A.risk_flags(V.annotated(spark, sf)).select("review_id", "green_flag", "switch_flag")


@query("rescale_01", V.scored_sql("SELECT review_id, sent_n, tone_n FROM scored"))
def rescale_01(spark, sf):
    return V.scored(V.reviews(spark, sf)).select("review_id", "sent_n", "tone_n")


@query("rescale_100", V.scored_sql("""
SELECT review_id, round_even(spam_confidence * 100, 1) AS score_100,
       CAST(round_even(spam_confidence * 100, 0) AS INTEGER) AS score_int FROM scored"""))
def rescale_100(spark, sf):
    c = F.col("spam_confidence")
    return V.scored(V.reviews(spark, sf)).select("review_id", S.rescale_100(c).alias("score_100"),
                                                 S.rescale_100_int(c).alias("score_int"))


@query("spam_decision", V.scored_sql("""
SELECT review_id, is_spam, spam_label = 'spam' AND round_even(spam_confidence, 2) > 0.9 AS is_spam_rounded
FROM scored"""))
def spam_decision(spark, sf):
    rounded = S.spam_decision(F.col("spam_label"), F.col("spam_confidence"), 2)
    return V.scored(V.reviews(spark, sf)).select("review_id", "is_spam", rounded.alias("is_spam_rounded"))


@query("review_weight", V.ann_sql("""
SELECT review_id, review_weight, CASE WHEN is_spam THEN 0.0::DOUBLE WHEN justification = 1 THEN 1.0::DOUBLE
                                      ELSE 0.9::DOUBLE END AS weight_two_factor FROM ann"""))
def review_weight(spark, sf):
    df = V.annotated(spark, sf)
    return df.select("review_id", "review_weight",
                     S.review_weight(F.col("is_spam"), F.col("justification") == 1).alias("weight_two_factor"))


@query("topic_coverage", V.ann_sql("""
, t AS (SELECT review_id, kw_billing + kw_service + kw_green AS total FROM ann)
SELECT review_id, round_even(total / CAST((SELECT CASE WHEN max(total) = 0 THEN 1 ELSE max(total) END FROM t)
       AS DOUBLE), 3) AS topic_cov_n FROM t"""))
def topic_coverage(spark, sf):
    return A.topic_coverage(V.annotated(spark, sf), [f"kw_{t}" for t in V.TOPICS]).select("review_id", "topic_cov_n")


LABELS = {"en": "🇬🇧 English", "fr": "🇫🇷 French", "de": "🇩🇪 German"}


@query("label_lookup", V.rev_sql(f"""
, l(code, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in LABELS.items())})
SELECT review_id, coalesce(label, product) AS product_label,
       regexp_replace(coalesce(label, product), '^\\S+ ', '') AS plain_label
FROM reviews LEFT JOIN l ON code = product"""))
def label_lookup(spark, sf):
    df = A.label_lookup(V.reviews(spark, sf), "product", dims.label_dim(spark, LABELS), "product_label")
    return df.select("review_id", "product_label", S.strip_label(F.col("product_label")).alias("plain_label"))


@query("gap_verdict", V.rev_sql("""
SELECT review_id, CASE WHEN review_id % 8 = 0 THEN 'unavailable' WHEN score > 0 THEN 'primary'
                       WHEN score < 0 THEN 'competitor' ELSE 'same' END AS leader,
       CASE WHEN score <= -10 THEN 'good' ELSE 'bad' END AS change,
       CASE WHEN score * 2 > 150 THEN 'spike' ELSE 'normal' END AS driver FROM reviews"""))
def gap_verdict(spark, sf):
    gap = F.when(F.col("review_id") % 8 != 0, F.col("score"))
    return V.reviews(spark, sf).select("review_id", S.gap_verdict(gap).alias("leader"),
                                       S.change_verdict(F.col("score")).alias("change"),
                                       S.driver_verdict(F.col("score") * 2).alias("driver"))
