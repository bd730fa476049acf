"""Queries over ranking, sampling and evidence assembly."""

from pyspark.sql import Window, functions as F

from voicegrid.functions.dates import week_ending_monday
from voicegrid.operators import rank as R, textjobs as T
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.plans.rollups import ASPECTS, REL_CTE, each, relevant
from voicegrid.sources.reviews import read_table

P = V.PRIMARY
RANKED = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY company, product ORDER BY review_weight DESC, review_id) AS rank
  FROM ann WHERE review_weight >= 0.4)"""


@query("topn_by_weight", V.ann_sql("""
SELECT review_id, company, product, review_weight,
       CAST(row_number() OVER (PARTITION BY company, product ORDER BY review_weight DESC, review_id) AS INTEGER) AS rank
FROM ann QUALIFY rank <= 7"""))
def topn_by_weight(spark, sf):
    return R.topn_by_weight(V.annotated(spark, sf), 7).select("review_id", "company", "product", "review_weight", "rank")


def balanced(spark, sf):
    cap = T.reviews_per_side()
    return R.balanced_topn(V.annotated(spark, sf), P, "co1", cap, threshold=0.4)


BALANCED_CTE = V.ANN_CTE + RANKED + f""", sides AS (
  SELECT product, least(count(*) FILTER (WHERE company = '{P}'), count(*) FILTER (WHERE company = 'co1'), 80) AS take
  FROM ranked WHERE company IN ('{P}', 'co1') GROUP BY product),
bal AS (SELECT r.* FROM ranked r JOIN sides USING (product) WHERE company IN ('{P}', 'co1') AND rank <= take)"""


@query("balanced_topn", f"""WITH {BALANCED_CTE}
SELECT review_id, company, product, CAST(rank AS INTEGER) AS rank FROM bal""")
def balanced_topn(spark, sf):
    return balanced(spark, sf).select("review_id", "company", "product", "rank")


@query("recent_n", V.scored_sql(f"""
, s AS (SELECT *, CASE WHEN company = '{P}' THEN 'primary' ELSE 'market' END AS side FROM scored)
SELECT review_id, year, product, side, CAST(row_number() OVER (PARTITION BY year, product, side
       ORDER BY date DESC, review_id) AS INTEGER) AS rank FROM s
QUALIFY rank <= CASE WHEN side = 'primary' THEN 26 ELSE 25 END"""))
def recent_n(spark, sf):
    return R.recent_n(V.scored(V.reviews(spark, sf)), P, 51).select("review_id", "year", "product", "side", "rank")


@query("topn_by_relevance", f"""WITH {REL_CTE},
l AS ({each("SELECT review_id, company, '@' AS aspect, relevance_@ AS relevance FROM rel WHERE relevance_@ > 0", sep=" UNION ALL ")})
SELECT *, CAST(row_number() OVER (PARTITION BY company, aspect ORDER BY relevance DESC, review_id) AS INTEGER) AS rank
FROM l QUALIFY rank <= 10""")
def topn_by_relevance(spark, sf):
    return R.topn_by_relevance(relevant(spark, sf), ASPECTS, 10)


@query("proportional_month_sample", V.scored_sql("""
, q AS (SELECT month, CAST(trunc(count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE) * 50) AS INTEGER) AS quota
        FROM scored GROUP BY month)
SELECT review_id, month, quota, CAST(row_number() OVER (PARTITION BY month ORDER BY md5('42:' || review_id), review_id)
       AS INTEGER) AS rank FROM scored JOIN q USING (month) QUALIFY rank <= quota"""))
def proportional_month_sample(spark, sf):
    return R.proportional_month_sample(V.scored(V.reviews(spark, sf))).select("review_id", "month", "quota", "rank")


@query("chronological_sort", V.sa_sql("SELECT month, company, product, sentiment_score FROM sa ORDER BY month"))
def chronological_sort(spark, sf):
    return R.chronological_sort(V.sa_monthly(spark, sf), "month", "company", "product").select(
        "month", "company", "product", "sentiment_score")


@query("last_k_weeks", V.rev_sql("""
SELECT CAST(date + CAST((8 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week, count(*) AS reviews FROM reviews
GROUP BY week ORDER BY week DESC LIMIT 12"""))
def last_k_weeks(spark, sf):
    weekly = V.reviews(spark, sf).groupBy(week_ending_monday(F.col("date")).alias("week")).agg(
        F.count("*").alias("reviews"))
    return R.last_k(weekly, "week", 12)


@query("numbered_evidence_text", V.ann_sql(f"""{RANKED}
SELECT company, product, md5(string_agg('Review ' || rank || ' (' || company || '): ' || trim(review), chr(10)
       ORDER BY rank)) AS digest FROM ranked WHERE rank <= 5 GROUP BY company, product"""))
def numbered_evidence_text(spark, sf):
    ranked = R.topn_by_weight(V.annotated(spark, sf).filter("review_weight >= 0.4"), 5)
    out = R.numbered_evidence_text(ranked, ["company", "product"], label=F.col("company"))
    return out.select("company", "product", F.md5("evidence").alias("digest"))


@query("ordered_turns_text", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
SELECT conv_id, md5(string_agg('Review ' || rank || ' (' || role || '): ' || trim(text), chr(10) ORDER BY rank)) AS digest
FROM e GROUP BY conv_id""")
def ordered_turns_text(spark, sf):
    """All turns of each conversation, in order."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read_table(spark, sf, "conversations").withColumn("rank", F.row_number().over(order))
    out = R.numbered_evidence_text(turns, ["conv_id"], "text", "rank", F.col("role"))
    return out.select("conv_id", F.md5("evidence").alias("digest"))


@query("side_by_side_context", f"""WITH {BALANCED_CTE}, t AS (
SELECT product, {", ".join(f"count(*) FILTER (WHERE company = '{c}') AS n_{c}, "
                           f"string_agg(review, ' ' ORDER BY rank) FILTER (WHERE company = '{c}') AS t_{c}" for c in (P, "co1"))}
FROM bal GROUP BY product)
SELECT product, md5('{P} Reviews (' || n_{P} || '):' || chr(10) || t_{P} || chr(10) || chr(10)
       || 'co1 Reviews (' || n_co1 || '):' || chr(10) || t_co1) AS digest FROM t""")
def side_by_side_context(spark, sf):
    return R.side_by_side_context(balanced(spark, sf), P, "co1").select("product", F.md5("context").alias("digest"))


@query("fixed_size_batches", """
SELECT doc_id AS review_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch,
       (row_number() OVER (ORDER BY doc_id) - 1) % 10 + 1 AS index_in_batch FROM documents""")
def fixed_size_batches(spark, sf):
    return R.fixed_size_batches(V.reviews(spark, sf).select("review_id"), "review_id", 10)
