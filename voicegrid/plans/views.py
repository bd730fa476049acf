"""The review tables that registered queries read, in Spark and in SQL.

``documents`` carries the text. Company, date and scores are derived from its key with integer
arithmetic, so both engines see the same rows. The text is invented prose, so dictionaries here
are words that occur in it; the domain dictionaries of ``voicegrid.dims`` are the defaults of the
operators themselves.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid import dims
from voicegrid.functions import dates as D, scores as S
from voicegrid.operators import annotate as A, lexicon as X, rollups as U
from voicegrid.sources.reviews import read_table

PRIMARY = "co0"
TOPICS = {"billing": ["the", "of", "and"], "service": ["to", "in", "is"], "green": ["this", "from"]}
ASPECTS = {"speed": ["the", "an"], "value": ["with", "as", "by"], "support": ["it", "for", "was"]}
CHANNELS = ["with", "from", "by", "an", "on"]
REASONS = ["as", "that", "for"]
DEBIT, PREPAY = ["of"], ["with", "this"]
BRAND, GAS, POWER = "the", ["the", "of", "in"], ["and", "to"]
FIXED, VARIABLE = ["was"], ["it", "for"]
INTENT, OUTCOME = ["ation", "ing the"], ["ent", "ion de"]
PHRASES = ["of the", "is that"]
PROMO, REGULATORY = ["ing of", "tion and"], ["sh th", "t&c", "er la"]
CATEGORIES = {"alpha": ["tionth", "quela"], "beta": ["ingin", "ption"], "gamma": ["and", "und"]}
RISK = {"tion": 1.0, "ment": 0.5, "sch": 1.0, "ando": 0.5}
RISKS = {"first": RISK, "second": {"ing of": 1.0, "tion": 0.5, "ungen": 2.0}, "absent": {"no such words": 1.0}}
LEXICON = [("the", 1.9, "word"), ("of", -1.5, "word"), ("in", 2.7, "word"), ("das", -2.1, "word"),
           ("la", 0.8, "word"), ("des", -0.9, "word"), ("los", 1.2, "word"),
           ("and", 0.293, "booster"), ("to", -0.293, "booster"), ("der", 0.293, "booster"),
           ("is", -0.74, "negator"), ("que", -0.74, "negator"), ("that", None, "contrast"),
           ("of the", 1.1, "idiom"), ("in la", -2.2, "idiom"), ("to of the", 2.4, "idiom"), ("des les", -1.7, "idiom"),
           ("this is", -0.293, "booster"), ("la que", 0.293, "booster"), ("and to the", 0.4, "booster")]

# Words that occur in the texts, in place of those of the rules.
SPECIAL = X.Words(least="for", not_least=("as", "with"), never="is", so=("the", "this", "on"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("review_id"), F.col("text").alias("review"),
        F.concat(F.lit("co"), (k % 5).cast("string")).alias("company"), F.col("lang").alias("product"),
        F.date_add(F.lit(date(2024, 1, 1)), ((k * 37) % 364).cast("int")).alias("date"),
        (((k * 31) % 201).cast("int") - 100).alias("score"))


def scored(df: DataFrame) -> DataFrame:
    """Columns that need no text: month, year, both sentiments, spam verdict and weight."""
    k = F.col("review_id")
    df = df.withColumns({
        "month": D.month_start(F.col("date")), "year": F.year("date"),
        "sentiment": F.col("score") / 100, "sent": F.col("score") / 100, "sent_n": S.rescale_01(F.col("score") / 100),
        "tone": (((k * 53) % 201).cast("int") - 100) / 100,
        "spam_label": F.when(k % 11 == 0, "spam").otherwise("ham"),
        "spam_confidence": ((k * 17) % 1001) / 1000,
    })
    df = df.withColumn("tone_n", S.rescale_01(F.col("tone")))
    return df.withColumn("is_spam", S.spam_decision(F.col("spam_label"), F.col("spam_confidence")))


# The dictionaries above, as annotation takes them.
WORDS = A.Dictionaries(topics=TOPICS, aspects=ASPECTS, categories=CATEGORIES, debit=DEBIT, prepay=PREPAY, own_brand=BRAND,
                       gas=GAS, power=POWER, fixed=FIXED, variable=VARIABLE, intent=INTENT, outcome=OUTCOME, reasons=REASONS,
                       meter=PHRASES, promo=PROMO, regulatory=REGULATORY, channels=CHANNELS)


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    return A.annotate(scored(reviews(spark, sf)), "review", "date", WORDS, ["sent", "tone"], "is_spam",
                      F.col("product") == "en")


def sa_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly company x product rollup with mention-weighted aspect scores and volumes."""
    ann = annotated(spark, sf)
    scores = []
    for a in ASPECTS:
        w = F.col(f"w_{a}")
        scores += [S.half_even(F.sum(F.col("score") * w) / F.nullif(F.sum(w), F.lit(0)), 1)
                   .alias(f"{a}_sentiment_score"), F.count_if(w > 0).alias(f"{a}_volume")]
    return ann.groupBy(*U.MONTHLY).agg(
        S.half_even(F.avg("score"), 1).alias("sentiment_score"), F.count("*").alias("reviews"), *scores)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _count(words) -> str:
    return f"CAST(len(list_filter(toks, lambda t: list_contains({_list(words)}, t))) AS INTEGER)"


def _any_sub(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def _phrase(words) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches(low, '(^|{edge})({'|'.join(words)})({edge}|$)')"


REVIEWS_CTE = r"""reviews AS (
  SELECT doc_id AS review_id, text AS review, 'co' || CAST(doc_id % 5 AS VARCHAR) AS company,
         lang AS product, DATE '2024-01-01' + CAST((doc_id * 37) % 364 AS INTEGER) AS date,
         CAST((doc_id * 31) % 201 AS INTEGER) - 100 AS score
  FROM documents)"""

SCORED_CTE = REVIEWS_CTE + r""", scored AS (
  SELECT *, round_even((tone + 1) / 2, 3) AS tone_n,
         spam_label = 'spam' AND spam_confidence > 0.9 AS is_spam
  FROM (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month, CAST(year(date) AS INTEGER) AS year,
               score / 100.0::DOUBLE AS sentiment, round_even((score / 100.0::DOUBLE + 1) / 2, 3) AS sent_n,
               (CAST((review_id * 53) % 201 AS INTEGER) - 100) / 100.0::DOUBLE AS tone,
               CASE WHEN review_id % 11 = 0 THEN 'spam' ELSE 'ham' END AS spam_label,
               ((review_id * 17) % 1001) / 1000.0::DOUBLE AS spam_confidence
        FROM reviews))"""

ANN_CTE = SCORED_CTE + r""", tok AS (
  SELECT *, lower(review) AS low, regexp_extract_all(lower(review), '[\p{L}\p{N}_]+') AS toks
  FROM scored), ann1 AS (
  SELECT *, """ + ", ".join(
    [f"{_count(v)} AS kw_{k}" for k, v in TOPICS.items()]
    + [f"{_count(v)} AS w_{k}" for k, v in ASPECTS.items()]
    + [f"CAST(list_contains(toks, '{c}') AS INTEGER) AS channel_{c}" for c in CHANNELS]) + r""",
    CAST(len(list_filter(regexp_split_to_array(review, '[\s\p{Z}]+'), lambda w: w <> '')) AS INTEGER) AS word_count,
    CASE WHEN list_has_any(toks, """ + _list(DEBIT) + r""") THEN 'Direct Debit'
         WHEN list_has_any(toks, """ + _list(PREPAY) + r""") THEN 'Prepayment Meter'
         ELSE 'Other/Unspecified' END AS payment_method,
    CASE sign(""" + _count([g for g in GAS if g != BRAND]) + " - " + _count(POWER) + r""")
         WHEN 1 THEN 'Gas Supply' WHEN -1 THEN 'Electricity' ELSE 'Unknown' END AS fuel_type,
    CASE WHEN list_has_any(toks, """ + _list(FIXED) + r""") THEN 'Fixed'
         WHEN list_has_any(toks, """ + _list(VARIABLE) + r""") THEN 'Variable' ELSE 'Unknown' END AS tariff_type,
    CASE WHEN """ + _any_sub(INTENT) + " THEN 'Intent' WHEN " + _any_sub(OUTCOME) + r""" THEN 'Outcome'
         ELSE 'None' END AS switching,
    CAST(list_has_any(toks, """ + _list(REASONS) + r""") AS INTEGER) AS justification,
    CAST(""" + _phrase(PHRASES) + r""" AS INTEGER) AS smart_meter_flag,
    CAST(""" + _any_sub(PROMO) + r""" AS INTEGER) AS promo_flag,
    CAST(""" + _any_sub(REGULATORY) + r""" AS INTEGER) AS reg_ref_flag,
    CASE """ + " ".join(f"WHEN {_any_sub(v)} THEN '{k}'" for k, v in CATEGORIES.items()) + r""" ELSE 'other' END AS category
  FROM tok), ann2 AS (
  SELECT *, CASE WHEN word_count < 50 THEN 'Short' WHEN word_count < 150 THEN 'Medium' ELSE 'Long' END AS length_cat,
         round_even(least(word_count / 150.0::DOUBLE, 1.0::DOUBLE), 3) AS length_score,
         CASE WHEN is_spam THEN 0.0::DOUBLE
              ELSE (CASE WHEN product = 'en' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
                   * (CASE WHEN justification = 1 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) END AS review_weight
  FROM ann1), cover AS (SELECT coalesce(nullif(max(""" + " + ".join(f"kw_{k}" for k in TOPICS) + r"""), 0), 1) AS top FROM ann2), ann3 AS (
  SELECT ann2.*, round_even((""" + " + ".join(f"kw_{k}" for k in TOPICS) + r""") / CAST(top AS DOUBLE), 3) AS topic_cov_n FROM ann2, cover), ann AS (
  SELECT *, CAST(round_even(CAST((sent_n + tone_n + topic_cov_n + length_score + justification + promo_flag + reg_ref_flag) / 7
         AS DECIMAL(20, 9)), 3) AS DOUBLE) AS quality_score FROM ann3)"""

SA_CTE = ANN_CTE + r""", sa AS (
  SELECT month, company, product, round_even(avg(score), 1) AS sentiment_score, count(*) AS reviews, """ + ", ".join(
    f"round_even(CAST(sum(score * w_{a}) AS DOUBLE) / nullif(sum(w_{a}), 0), 1) AS {a}_sentiment_score, "
    f"count(*) FILTER (WHERE w_{a} > 0) AS {a}_volume" for a in ASPECTS) + r"""
  FROM ann GROUP BY ALL)"""


def tie_safe(value: str, places: int) -> str:
    """SQL for half-even rounding of a mean after its binary noise is removed."""
    return f"CAST(round_even(CAST({value} AS DECIMAL(28, 9)), {places}) AS DOUBLE)"


def rev_sql(body: str) -> str:
    return f"WITH {REVIEWS_CTE}\n{body}"


def scored_sql(body: str) -> str:
    return f"WITH {SCORED_CTE}\n{body}"


def ann_sql(body: str) -> str:
    return f"WITH {ANN_CTE}\n{body}"


def sa_sql(body: str) -> str:
    return f"WITH {SA_CTE}\n{body}"
