"""Queries that run a stream to the end of the available data and read its output."""

from pyspark.sql import functions as F

from voicegrid.operators import annotate as A
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.plans.risk import WEEK
from voicegrid.session import work_dir
from voicegrid.sources.reviews import read_table
from voicegrid.streaming import jobs as J


@query("streaming_weekly_mentions", f"""
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS date FROM events)
SELECT {WEEK} AS week, event_type, count(*) AS mentions FROM e GROUP BY ALL""")
def streaming_weekly_mentions(spark, sf):
    out = work_dir(spark, "weekly-stream")
    events = J.table_stream(spark, sf, "events", read_table(spark, sf, "events").schema)
    J.start_weekly_mentions(events, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return J.latest_counts(spark, f"{out}/counts", ["week", "event_type"])


@query("streaming_annotate_append", V.ann_sql("""
SELECT review_id, kw_billing, kw_service, kw_green, length(review) AS chars FROM ann"""))
def streaming_annotate_append(spark, sf):
    out = work_dir(spark, "annotate-stream")
    docs = J.table_stream(spark, sf, "documents", read_table(spark, sf, "documents").schema)

    def annotate(df):
        df = df.select(F.col("doc_id").alias("review_id"), F.col("text").alias("review"))
        counted = A.topic_keyword_counts(df, "review", V.TOPICS)
        return counted.withColumn("chars", F.length("review").cast("bigint")).drop("review")
    J.start_annotate_append(docs, annotate, f"{out}/annotated", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/annotated")
