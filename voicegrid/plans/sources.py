"""Queries over sources and sinks. Files they write go to the shared working folder."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid import schema
from voicegrid.functions import dates as D, scores as S
from voicegrid.operators import clean as C
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.session import work_dir
from voicegrid.sources import reviews as R, sinks as K

ANALYSES = ["classification", "sentiment"]

# A date text in each of the spellings that exports contain, derived from the review's date.
DATE_FORMS = ["dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "dd/MM/yy"]


def date_texts(df: DataFrame) -> DataFrame:
    """Reviews with their date written in one of several forms, some of them no dates."""
    form = F.col("review_id") % 6
    text = F.lit("")
    for i, f in enumerate(DATE_FORMS):
        text = F.when(form == i, F.date_format("date", f)).otherwise(text)
    text = F.when(form == 4, "31/02/2024").otherwise(text)
    return df.withColumn("date_text", text)


DATE_TEXT_CTE = V.REVIEWS_CTE + r""", dated AS (
  SELECT *, CASE review_id % 6 WHEN 0 THEN strftime(date, '%d/%m/%Y')
                WHEN 1 THEN day(date) || '/' || month(date) || '/' || year(date)
                WHEN 2 THEN strftime(date, '%Y-%m-%d') WHEN 3 THEN strftime(date, '%d/%m/%y')
                WHEN 4 THEN '31/02/2024' ELSE '' END AS date_text,
         CASE WHEN review_id % 6 < 4 THEN date END AS parsed
  FROM reviews)"""


@query("scan_reviews_csv", V.rev_sql(r"""
SELECT strftime(date, '%d/%m/%Y') AS date, CAST(review_id % 5 + 1 AS INTEGER) AS rating, company,
       md5(review) AS digest, length(review) AS chars FROM reviews"""))
def scan_reviews_csv(spark, sf):
    path = work_dir(spark, "reviews-csv")
    out = V.reviews(spark, sf).select(
        F.date_format("date", "dd/MM/yyyy").alias("Date"), (F.col("review_id") % 5 + 1).alias("Rating"),
        F.lit("a \"quoted\", title").alias("Title"), F.col("review").alias("Review"),
        F.col("company").alias("Company"))
    out.write.options(header="true", quote='"', escape='"', quoteAll="true",
                      ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    df = C.normalize_headers(R.scan_reviews_csv(spark, path))
    return df.select("date", "rating", "company", F.md5("review").alias("digest"),
                     F.length("review").cast("bigint").alias("chars"))


@query("contract_check", V.rev_sql("""
SELECT company, count(*) AS n, 'rating, title' AS missing FROM reviews GROUP BY company"""))
def contract_check(spark, sf):
    df = schema.contract_check(V.reviews(spark, sf), ["date", "review", "company", "product"])
    missing = schema.missing_columns(df, ["review", "rating", "title"])
    return df.groupBy("company").agg(F.count("*").alias("n"), F.lit(", ".join(missing)).alias("missing"))


@query("normalize_headers", V.rev_sql("SELECT review_id, date, company, product FROM reviews"))
def normalize_headers(spark, sf):
    df = V.reviews(spark, sf).select("review_id", F.col("date").alias(" Date "), F.col("company").alias("Company"),
                                     F.col("product").alias("Final Product Category"))
    return C.normalize_headers(df)


@query("parse_date_strict", V.rev_sql(r"""
SELECT review_id, CAST(strptime(strftime(date, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed FROM reviews"""))
def parse_date_strict(spark, sf):
    df = V.reviews(spark, sf).withColumn("text", F.date_format("date", "dd/MM/yyyy"))
    return df.select("review_id", D.parse_strict(F.col("text")).alias("parsed"))


@query("parse_date_lenient", f"WITH {DATE_TEXT_CTE} SELECT review_id, parsed FROM dated")
def parse_date_lenient(spark, sf):
    return date_texts(V.reviews(spark, sf)).select("review_id", D.parse_lenient(F.col("date_text")).alias("parsed"))


@query("parse_date_majority", V.rev_sql(r"""
, t AS (SELECT review_id, strftime(date, '%m/%d/%Y') AS txt FROM reviews),
p AS (SELECT review_id, try_strptime(txt, '%d/%m/%Y') AS a, try_strptime(txt, '%m/%d/%Y') AS b FROM t)
SELECT review_id, CAST(CASE WHEN (SELECT 2 * count(*) FILTER (WHERE a IS NULL) > count(*) FROM p)
                            THEN b ELSE a END AS DATE) AS parsed FROM p"""))
def parse_date_majority(spark, sf):
    df = V.reviews(spark, sf).withColumn("text", F.date_format("date", "MM/dd/yyyy"))
    return C.parse_date_majority(df, "text", "parsed").select("review_id", "parsed")


@query("parse_percent", V.rev_sql(r"""
, t AS (SELECT review_id, CASE WHEN review_id % 7 = 0 THEN 'n/a' ELSE score || '%' END AS p FROM reviews)
SELECT review_id, TRY_CAST(replace(p, '%', '') AS DOUBLE) AS pct FROM t"""))
def parse_percent(spark, sf):
    text = F.when(F.col("review_id") % 7 == 0, "n/a").otherwise(F.concat(F.col("score").cast("string"), F.lit("%")))
    return V.reviews(spark, sf).select("review_id", S.parse_percent(text).alias("pct"))


@query("default_column", V.rev_sql("""
SELECT review_id, company, 'Energy' AS product, '' AS detected_lang FROM reviews"""))
def default_column(spark, sf):
    df = V.reviews(spark, sf).select("review_id", "company")
    for name, value in (("company", "nobody"), ("product", "Energy"), ("detected_lang", "")):
        df = C.default_column(df, name, value)
    return df


@query("company_partition_read", V.rev_sql("""
SELECT review_id, product, score, company FROM reviews WHERE company = 'co3'"""))
def company_partition_read(spark, sf):
    path = work_dir(spark, "by-company")
    K.write_per_company(V.reviews(spark, sf).drop("review"), path)
    return R.company_partition_read(spark, path, "co3").select("review_id", "product", "score", "company")


@query("write_per_company", V.rev_sql("""
SELECT company, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM reviews GROUP BY company"""))
def write_per_company(spark, sf):
    path = work_dir(spark, "per-company")
    K.write_per_company(V.reviews(spark, sf), path)
    return spark.read.parquet(path).groupBy("company").agg(
        F.count("review").alias("n"), F.sum("score").alias("total"))


@query("write_report_csv", V.scored_sql(r"""
SELECT strftime(month, '%Y-%m') AS month, company, CAST(count(*) AS VARCHAR) AS reviews,
       printf('%.3f', round_even(avg(sentiment), 3)) AS sentiment_score
FROM scored GROUP BY month, company"""))
def write_report_csv(spark, sf):
    path = work_dir(spark, "report")
    rollup = V.scored(V.reviews(spark, sf)).groupBy("month", "company").agg(
        F.avg("sentiment").alias("sentiment_score"), F.count("*").alias("reviews"))
    K.write_report_csv(rollup, path, ["month", "company", "reviews", "sentiment_score"], places=3)
    return spark.read.schema("month string, company string, reviews string, sentiment_score string").csv(
        path, header=True)


@query("append_results", V.rev_sql("SELECT review_id, score FROM reviews"))
def append_results(spark, sf):
    path, df = work_dir(spark, "results"), V.reviews(spark, sf).select("review_id", "score")
    K.append_results(df.filter("score < 0"), path)
    K.append_results(df.filter("score >= 0"), path)
    return spark.read.parquet(path)


@query("resume_unprocessed", """
SELECT doc_id AS review_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_unprocessed(spark, sf):
    done = R.read_table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"))
    return K.resume_unprocessed(V.reviews(spark, sf).select("review_id"), done, "review_id")


@query("run_log_append", V.rev_sql("""
SELECT 'documents' AS input_file, count(*) AS total_rows, count(*) FILTER (WHERE score >= 0) AS rows_processed,
       'classification, sentiment' AS analyses FROM reviews"""))
def run_log_append(spark, sf):
    path = work_dir(spark, "run-log")
    counts = V.reviews(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0).alias("done")).first()
    K.run_log_append(spark, path, "documents", "results", counts["n"], counts["done"], ANALYSES, "model", 0.1, 500, 0.0)
    return spark.read.parquet(path).select("input_file", "total_rows", "rows_processed", "analyses")
