"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voicegrid.plans import QUERIES  # noqa: E402
from voicegrid.session import local_session  # noqa: E402

HEADLINE = [
    "weighted_monthly_aspect", "monthly_aspect_rollup", "topic_keyword_counts", "tfidf_topic_score",
    "tfidf_aspect_cosine", "lexicon_compound", "lexicon_polarity", "sentence_scoped_sentiment",
    "language_tag", "dedup_exact_keep_first", "category_summary", "quality_describe", "company_scorecard",
    "balanced_topn", "topn_by_relevance", "proportional_month_sample", "best_competitor", "latest_gap",
    "fill_missing_replies", "recent_vs_baseline", "weekly_mentions", "spearman_matrix", "rank_reorder",
    "column_ranks", "pearson_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("bench", cpus)
    QUERIES["monthly_volume"](spark, folder).collect()  # start workers and load classes
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
