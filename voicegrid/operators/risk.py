"""Weekly series and emerging-risk indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import dims
from voicegrid.functions import dates as D, scores as S, words as W

RECENT_DAYS, BASE_DAYS = 7, 90


def with_week_spine(weekly: DataFrame, week: str, fill: Mapping[str, float | int | None]) -> DataFrame:
    """Add the weeks without rows; counts become 0 and means stay NULL.

    The calendar comes from the first and last week, one aggregate row.
    """
    span = weekly.agg(F.min(week).alias("_a"), F.max(week).alias("_b")).filter(F.col("_a").isNotNull())
    spine = span.select(F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias(week))
    out = spine.join(weekly, week, "left")
    return out.fillna({c: v for c, v in fill.items() if v is not None})


def weekly_flag_sum(df: DataFrame, flag: str, date: str = "date") -> DataFrame:
    weekly = df.groupBy(D.week_ending_monday(F.col(date)).alias("week")).agg(
        F.sum(F.col(flag).cast("bigint")).alias("total"))
    return with_week_spine(weekly, "week", {"total": 0})


def weekly_mean(df: DataFrame, value: str, date: str = "date", out: str = "mean") -> DataFrame:
    weekly = df.groupBy(D.week_ending_monday(F.col(date)).alias("week")).agg(F.avg(value).alias(out))
    return with_week_spine(weekly, "week", {})


def weekly_mentions(df: DataFrame, text: str, keywords: Sequence[str], date: str = "date") -> DataFrame:
    weekly = (df.filter(W.has_substring(F.col(text), keywords))
              .groupBy(D.week_ending_monday(F.col(date)).alias("week")).agg(F.count("*").alias("mentions")))
    return with_week_spine(weekly, "week", {"mentions": 0})


def last_k_weeks(weekly: DataFrame, k: int = 12, week: str = "week") -> DataFrame:
    return weekly.orderBy(F.desc(week)).limit(k).orderBy(week)


def _windowed(df: DataFrame, date: str, recent: int, base: int) -> DataFrame:
    """Mark rows of the last ``recent`` days and of the ``base`` days before them; drop the rest.

    The first day to keep is a scalar subquery on the last date of the table, so the scan can
    skip the files of all earlier days.
    """
    first = df.agg(F.date_sub(F.max(date), recent + base - 1).alias("x")).scalar()
    first_recent = df.agg(F.date_sub(F.max(date), recent - 1).alias("x")).scalar()
    return df.filter(F.col(date) >= first).withColumn("_recent", F.col(date) >= first_recent)


def _mention_weight(text: Column, keywords: Mapping[str, float]) -> Column:
    lowered = F.lower(text)
    total = F.lit(0.0)
    for word, weight in keywords.items():
        total = total + F.when(F.contains(lowered, F.lit(word.lower())), float(weight)).otherwise(0.0)
    return total


def _per_window(name: str, aggregate, condition: Column | None = None) -> list[Column]:
    hit = F.lit(True) if condition is None else condition
    return [aggregate(F.col("_recent") & hit).alias(f"recent_{name}"),
            aggregate(~F.col("_recent") & hit).alias(f"base_{name}")]


def recent_vs_baseline(df: DataFrame, text: str, keywords: Mapping[str, float], date: str = "date",
                       sentiment: str = "sentiment", recent: int = RECENT_DAYS,
                       base: int = BASE_DAYS) -> DataFrame:
    """Weighted mentions of the last days against the baseline before them, in one pass.

    ``base_avg`` scales the baseline to the length of the recent window.
    """
    w = _mention_weight(F.col(text), keywords)
    rows = _windowed(df, date, recent, base).withColumn("_w", w).filter(F.col("_w") > 0)
    row = rows.agg(
        *_per_window("count", lambda c: F.coalesce(F.sum(F.when(c, F.col("_w"))), F.lit(0.0))),
        *_per_window("sentiment", lambda c: F.avg(F.when(c, F.col(sentiment)))))
    scaled = F.col("base_count") * recent / base
    ratio = F.col("recent_count") / F.nullif(scaled, F.lit(0.0))
    return row.select(
        "recent_count", "base_count", S.half_even(scaled, 1).alias("base_avg"),
        ratio.alias("rate_ratio"), ((ratio - 1) * 100).alias("change_pct"),
        S.change_verdict((ratio - 1) * 100).alias("verdict"), "recent_sentiment", "base_sentiment")


def risk_drivers(df: DataFrame, text: str, keywords: Sequence[str], date: str = "date",
                 sentiment: str = "sentiment", recent: int = RECENT_DAYS, base: int = BASE_DAYS,
                 top: int = 3) -> DataFrame:
    """Keywords whose mentions grew most against their baseline, with their sentiment shift."""
    lowered = F.lower(text)
    found = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(lowered, k))
    rows = _windowed(df, date, recent, base).select("_recent", sentiment, F.explode(found).alias("keyword"))
    stats = rows.groupBy("keyword").agg(
        *_per_window("count", F.count_if),
        *_per_window("sentiment", lambda c: F.avg(F.when(c, F.col(sentiment)))))
    ratio = F.col("recent_count") / F.nullif(F.col("base_count") * recent / base, F.lit(0.0))
    return (stats.select("keyword", "recent_count", ratio.alias("ratio"),
                         (F.col("recent_sentiment") - F.col("base_sentiment")).alias("sent_diff"))
            .withColumn("level", S.driver_verdict(F.col("ratio") * 100))
            .orderBy(F.desc_nulls_last("ratio"), "keyword").limit(top))


def risk_overview(df: DataFrame, text: str, maps: Mapping[str, Mapping[str, float]] = dims.RISK_TERMS, date: str = "date",
                  sentiment: str = "sentiment", recent: int = RECENT_DAYS, base: int = BASE_DAYS, top: int = 3) -> DataFrame:
    """``recent_vs_baseline`` and the ``top`` drivers of several weighted keyword maps, from one scan and one shuffle.

    One row per map, in any case: ``risk``, the columns of ``recent_vs_baseline``, and ``drivers``, an array of
    ``(keyword, recent_count, ratio, sent_diff, level)`` with the highest ratio first. Each text is searched once
    for every different keyword of all maps; a hit is passed on as a row for the map and one for the keyword.
    """
    words = sorted({k.lower() for m in maps.values() for k in m})
    lowered = F.lower(text)
    found = F.filter(F.array(*[F.lit(k) for k in words]), lambda k: F.contains(lowered, k))
    rows = _windowed(df, date, recent, base).select("_recent", sentiment, found.alias("_found")).filter(F.size("_found") > 0)

    def weight(m: Mapping[str, float]) -> Column:
        total = F.lit(0.0)
        for k, w in m.items():
            total = total + F.when(F.array_contains("_found", k.lower()), float(w)).otherwise(0.0)
        return total

    def cell(risk: str, value: Column):
        return lambda keyword: F.struct(F.lit(risk).alias("risk"), keyword.alias("keyword"), value.alias("w"))

    none = F.lit(None).cast("string")
    cells = [F.array(cell(r, weight(m))(none)) for r, m in maps.items()]
    cells += [F.transform(F.filter("_found", W.in_list([k.lower() for k in m])), cell(r, F.lit(1.0))) for r, m in maps.items()]
    hits = rows.select("_recent", sentiment, F.explode(F.flatten(F.array(*cells))).alias("_c")).select("_recent", sentiment, "_c.*").filter("w > 0")
    stats = hits.groupBy("risk", "keyword").agg(
        *_per_window("count", lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))),
        *_per_window("sentiment", lambda c: F.avg(F.when(c, F.col(sentiment)))))
    scaled = F.col("base_count") * recent / base
    ratio = F.col("recent_count") / F.nullif(scaled, F.lit(0.0))
    rated = stats.withColumn("ratio", ratio)
    # What follows has a row per map and keyword. Sorted by falling ratio, unknown ratios last.
    driver = F.struct(F.coalesce(-F.col("ratio"), F.lit(float("inf"))).alias("order"), "keyword", F.col("recent_count").cast("bigint").alias("recent_count"), "ratio",
                      (F.col("recent_sentiment") - F.col("base_sentiment")).alias("sent_diff"), S.driver_verdict(F.col("ratio") * 100).alias("level"))
    whole = F.when(F.col("keyword").isNull(), F.struct("recent_count", "base_count", scaled.alias("scaled"), "ratio", "recent_sentiment", "base_sentiment"))
    per_map = rated.groupBy("risk").agg(
        F.max(whole).alias("_all"), F.array_sort(F.collect_list(F.when(F.col("keyword").isNotNull(), driver))).alias("_drivers"))
    names = df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(maps)], "risk string, ord int")
    out = names.join(per_map, "risk", "left")
    change = (F.col("_all.ratio") - 1) * 100
    kept = F.transform(F.slice("_drivers", 1, top), lambda d: F.struct(*[d[c].alias(c) for c in ("keyword", "recent_count", "ratio", "sent_diff", "level")]))
    return out.select(
        "risk", F.coalesce("_all.recent_count", F.lit(0.0)).alias("recent_count"), F.coalesce("_all.base_count", F.lit(0.0)).alias("base_count"),
        S.half_even(F.coalesce("_all.scaled", F.lit(0.0)), 1).alias("base_avg"), F.col("_all.ratio").alias("rate_ratio"), change.alias("change_pct"),
        S.change_verdict(change).alias("verdict"), F.col("_all.recent_sentiment").alias("recent_sentiment"),
        F.col("_all.base_sentiment").alias("base_sentiment"), kept.alias("drivers"))


def sentiment_shift(df: DataFrame, date: str = "date", sentiment: str = "sentiment",
                    recent: int = RECENT_DAYS, base: int = BASE_DAYS,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Mean sentiment of the last days minus that of the baseline, in points of 100."""
    stats = _windowed(df, date, recent, base).groupBy(*keys).agg(
        *_per_window("sentiment", lambda c: F.avg(F.when(c, F.col(sentiment)))))
    return stats.withColumn("shift_points", (F.col("recent_sentiment") - F.col("base_sentiment")) * 100)
