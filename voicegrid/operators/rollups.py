"""Monthly and corpus-level aggregates.

Every rollup over several aspects, topics or flags is one conditional aggregate in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import dims
from voicegrid.functions import scores as S
from voicegrid.operators import rank as R
from voicegrid.session import store

MONTHLY = ("month", "company", "product")


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with a NULL key are not reported."""
    return df.dropna(subset=list(keys))


def group_means(df: DataFrame, keys: Sequence[str], values: Mapping[str, str],
                places: int | None = None) -> DataFrame:
    """Mean of several columns per group; ``values`` maps output name to column."""
    def mean(c: str) -> Column:
        return F.avg(c) if places is None else S.half_even(F.avg(c), places)
    return known_keys(df, keys).groupBy(*keys).agg(*[mean(c).alias(o) for o, c in values.items()])


# -- monthly rollups ----------------------------------------------------------------------


def monthly_overall_rollup(df: DataFrame, score: str, keys: Sequence[str] = MONTHLY) -> DataFrame:
    return known_keys(df, keys).groupBy(*keys).agg(
        F.count("*").alias("reviews"), F.avg(score).alias("sentiment_score"),
        F.stddev_samp(score).alias("sentiment_volatility"))


def monthly_aspect_rollup(df: DataFrame, score: str, aspects: Sequence[str], min_relevance: int = 1,
                          keys: Sequence[str] = MONTHLY) -> DataFrame:
    """Overall and per-aspect mean, deviation and volume; an aspect counts where it is relevant."""
    per_aspect = []
    for a in aspects:
        value = F.when(F.col(f"relevance_{a}") >= min_relevance, F.col(score))
        volume = F.count_if(F.col(f"relevance_{a}") >= min_relevance)
        per_aspect += [F.avg(value).alias(f"{a}_sentiment_score"),
                       F.stddev_samp(value).alias(f"{a}_volatility"),
                       F.nullif(volume, F.lit(0)).alias(f"{a}_volume")]
    return known_keys(df, keys).groupBy(*keys).agg(
        F.count("*").alias("reviews"), F.avg(score).alias("sentiment_score"),
        F.stddev_samp(score).alias("sentiment_volatility"), *per_aspect)


def monthly_precise_rollup(df: DataFrame, aspects: Sequence[str], keys: Sequence[str] = MONTHLY,
                           score: str = "sentiment") -> DataFrame:
    """Mean and deviation of sentence-scoped scores with the group's volume.

    Takes one row per review and aspect, as ``sentence_scoped_sentiment`` gives them with the group's keys,
    and pivots them within the aggregate. Scores in [-1, 1] are first scaled to 100 and rounded half to even
    as decimals, one place.
    """
    stats = []
    for a in aspects:
        value = F.when(F.col("aspect") == a, S.half_even(F.col(score) * 100, 1))
        stats += [F.avg(value).alias(f"{a}_sentiment_score"), F.stddev_samp(value).alias(f"{a}_volatility")]
    volume = F.count_if(F.col("aspect") == aspects[0]).alias("reviews")
    return known_keys(df, keys).groupBy(*keys).agg(*stats, volume)


def rollup_numeric_contract(df: DataFrame, truncated: Sequence[str], rounded: Sequence[str],
                            quality: Column | None = None) -> DataFrame:
    """NULL to 0; some columns cut to integers, others rounded to one place; quality attached."""
    df = df.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in truncated},
        **{c: S.half_even(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 1) for c in rounded}})
    return df if quality is None else df.withColumn("data_quality_score", S.half_even(quality, 1))


def monthly_product_company_stats(df: DataFrame, text: str, score: str) -> DataFrame:
    keys = ("month", "product", "company")
    return known_keys(df, keys).groupBy(*keys).agg(
        F.count(text).alias("total_reviews"), F.avg(score).alias("sentiment_score"))


def aspect_median_threshold(df: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """One row with the corpus median relevance of every aspect, exact for counts and for continuous values."""
    found = R.group_quantiles(df, [], [f"relevance_{a}" for a in aspects], [0.5])
    return found.agg(*[F.max(F.when(F.col("series") == f"relevance_{a}", F.col("q")[0])).alias(f"median_{a}") for a in aspects])


def threshold_aspect_rollup(df: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """Per group: mean aspect sentiment and count over rows at or above the corpus median."""
    keys = ("month", "product", "company")
    row = aspect_median_threshold(df, aspects)
    medians = row.select(F.struct(*row.columns).alias("x")).scalar()
    stats = []
    for a in aspects:
        relevant = ((F.coalesce(F.col(f"relevance_{a}"), F.lit(0.0)) >= F.col(f"_medians.median_{a}"))
                    & F.col(f"{a}_sentiment_score").isNotNull())
        stats += [F.avg(F.when(relevant, F.col(f"{a}_sentiment_score"))).alias(f"{a}_sentiment_score"),
                  F.count_if(relevant).alias(f"count_relevant_{a}")]
    return known_keys(df, keys).withColumn("_medians", medians).groupBy(*keys).agg(*stats)


def monthly_category_rollup(df: DataFrame, category: str, score: str) -> DataFrame:
    keys = ("month", category, "company")
    return known_keys(df, keys).groupBy(*keys).agg(
        S.half_even(F.avg(score)).cast("int").alias("sentiment_score"),
        F.count("*").alias("reviews_count"))


def monthly_base_sentiment(df: DataFrame, score_01: str, text: str, keys: Sequence[str] = MONTHLY,
                           scale: float = 100) -> DataFrame:
    return known_keys(df, keys).groupBy(*keys).agg(
        S.half_even(scale * F.avg(score_01)).alias("sentiment_score"), F.count(text).alias("reviews"))


def weighted_monthly_aspect(df: DataFrame, score_01: str, aspects: Sequence[str], text: str,
                            keys: Sequence[str] = MONTHLY, scale: float = 100) -> DataFrame:
    """Base sentiment plus one mention-weighted score per aspect; NULL where nobody mentions it."""
    scores = [
        S.half_even(scale * F.sum(F.col(score_01) * F.col(f"w_{a}"))
                    / F.nullif(F.sum(f"w_{a}"), F.lit(0)), 1).alias(f"{a}_sentiment_score")
        for a in aspects]
    return known_keys(df, keys).groupBy(*keys).agg(
        S.half_even(scale * F.avg(score_01)).alias("sentiment_score"),
        F.count(text).alias("reviews"), *scores)


def weighted_aspect_grid(df: DataFrame, score_01: str, aspects: Sequence[str],
                         scale: float = 100) -> DataFrame:
    """Company x product x aspect, every cell present; NULL where nobody mentions the aspect.

    One conditional aggregate yields the occurring cells. The grid multiplies the distinct
    companies, products and aspects, which are names of a dimension, not review rows.
    """
    sums = df.groupBy("company", "product").agg(*[
        S.half_even(scale * F.sum(F.col(score_01) * F.col(f"w_{a}"))
                    / F.nullif(F.sum(f"w_{a}"), F.lit(0)), 1).alias(a) for a in aspects])
    cells = sums.unpivot(["company", "product"], list(aspects), "aspect", "sentiment_score")
    grid = name_grid(sums, "company", "product").withColumn(
        "aspect", F.explode(F.array(*[F.lit(a) for a in aspects])))
    return grid.join(cells, ["company", "product", "aspect"], "left")


def name_grid(df: DataFrame, *columns: str) -> DataFrame:
    """All combinations of the names that occur in each column.

    Names are gathered as sets in one aggregate row and then exploded one column after the
    other, so the grid is built without joining tables.
    """
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in columns])
    done: list[str] = []
    for c in columns:
        rest = [f"_{x}" for x in columns if x not in done and x != c]
        row = row.select(*done, *rest, F.explode(f"_{c}").alias(c))
        done.append(c)
    return row.select(*columns)


def market_grid(df: DataFrame, date: str, products: Sequence[str], aspects: Sequence[str],
                text: str = "AI Gen Summary Here...") -> DataFrame:
    """Year x product x aspect skeleton for the summaries to be filled in."""
    years = df.groupBy(F.year(date).alias("year")).agg(F.lit(text).alias("analysis"))
    return (years.withColumn("product", F.explode(F.array(*[F.lit(p) for p in products])))
            .withColumn("aspect", F.explode(F.array(*[F.lit(a) for a in aspects])))
            .select("year", "product", "aspect", "analysis"))


# -- trends -------------------------------------------------------------------------------


def trend(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Mean of one column per group, ordered by the keys; ``month`` is usually the first."""
    return group_means(df, keys, {out or value: value}).orderBy(*keys)


def aspect_trend_long(df: DataFrame, keys: Sequence[str], aspects: Sequence[str]) -> DataFrame:
    """The aspect score columns of a rollup as one long series per aspect."""
    named = df.select(*keys, *[F.col(f"{a}_sentiment_score").alias(a) for a in aspects])
    return named.unpivot(list(keys), list(aspects), "aspect", "sentiment_score")


def score_distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """Five-number summary per group, exact; groups without a value have no row."""
    found = R.group_quantiles(df, [key], [value], [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ("minimum", "q1", "median", "q3", "maximum")
    return found.select(key, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def aspect_mean_truncated(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return known_keys(df, keys).groupBy(*keys).agg(F.avg(value).cast("int").alias(value))


def volume(df: DataFrame, *keys: str) -> DataFrame:
    return known_keys(df, keys).groupBy(*keys).agg(F.count("*").alias("reviews"))


def share_of(df: DataFrame, key: str, out: str = "pct", places: int = 0) -> DataFrame:
    """Count and percentage of all rows per value; the total is summed over the small counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("reviews"))
    total = counts.agg(F.sum("reviews").alias("x")).scalar()
    return known_keys(counts, [key]).select(
        key, "reviews", S.half_even(F.col("reviews") / total * 100, places).alias(out))


def share_of_known(df: DataFrame, key: str, out: str = "pct") -> DataFrame:
    """As ``share_of``, with rows that lack a value left out of the total as well."""
    return share_of(df.filter(F.col(key).isNotNull()), key, out)


def category_share_trend(df: DataFrame, category: str, values: Sequence[str],
                         month: str = "month") -> DataFrame:
    """Monthly percentage of each chosen category; months without the category have no row.

    One aggregate per month counts the total and every category together.
    """
    counts = known_keys(df, [month]).groupBy(month).agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.col(category) == v).alias(v) for v in values])
    long = counts.unpivot([month, "_total"], list(values), "category", "_n")
    return long.filter("_n > 0").select(
        month, "category", S.half_even(F.col("_n") / F.col("_total") * 100, 2).alias("pct"))


def flag_share_trend(df: DataFrame, flag: str, month: str = "month") -> DataFrame:
    counts = known_keys(df, [month]).groupBy(month).agg(
        F.count("*").alias("reviews"), F.count_if(F.col(flag) == 1).alias("n"))
    return counts.filter("n > 0").select(
        month, "n", "reviews", S.half_even(F.col("n") / F.col("reviews") * 100, 2).alias("pct"))


def concat_category_trends(df: DataFrame, categories: Mapping[str, Sequence[str]], month: str = "month") -> DataFrame:
    """The shares of ``category_share_trend`` for several columns, stacked; all are counted in one aggregate."""
    names = {f"{c}|{v}": (c, v) for c, vs in categories.items() for v in vs}
    counts = known_keys(df, [month]).groupBy(month).agg(
        F.count("*").alias("_total"), *[F.count_if(F.col(c) == v).alias(n) for n, (c, v) in names.items()])
    long = counts.unpivot([month, "_total"], list(names), "_name", "_n").filter("_n > 0")
    return long.select(month, F.substring_index("_name", "|", -1).alias("category"),
                       S.half_even(F.col("_n") / F.col("_total") * 100, 2).alias("pct"))


def trend_with_total(df: DataFrame, value: str, group: str = "company", total: str = "all", month: str = "month") -> DataFrame:
    """Monthly mean per group and, under the name ``total``, over all rows, in one pass over them.

    Rows without a group count in the total only.
    """
    sums = known_keys(df, [month]).groupingSets([[month, group], [month]], month, group).agg(
        F.avg(value).alias(value), F.grouping(group).alias("_all"))
    named = F.when(F.col("_all") == 1, total).otherwise(F.col(group))
    return sums.withColumn(group, named).drop("_all").filter(F.col(group).isNotNull())


def company_scorecard(df: DataFrame, sentiment: str, quality: str) -> DataFrame:
    return known_keys(df, ["company"]).groupBy("company").agg(
        F.avg(sentiment).alias("avg_sentiment"), F.avg(quality).alias("avg_quality"),
        F.count("*").alias("reviews"))


def topic_averages(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Mean keyword count (2 places) and TF-IDF (3 places) per topic, in long form."""
    row = df.agg(*[S.half_even(F.avg(f"kw_{t}"), 2).alias(f"{t}|avg_kw") for t in topics],
                 *[S.half_even(F.avg(f"tfidf_{t}"), 3).alias(f"{t}|avg_tfidf") for t in topics])
    long = row.unpivot([], row.columns, "_name", "value")
    parts = F.split("_name", r"\|")
    return long.select(parts[0].alias("topic"), parts[1].alias("metric"), "value")


def topic_sentiment_trend(df: DataFrame, count: str, value: str) -> DataFrame:
    return trend(df.filter(F.col(count) > 0), ["month", "company"], value)


# -- distributions and summaries --------------------------------------------------------------


def score_histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width bins over the joint range of the columns; the maximum falls in the last bin."""
    long = df.select(*columns).unpivot([], list(columns), "method", "score").dropna(subset=["score"])
    span = long.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("x")).scalar()
    width = (F.col("_span.hi") - F.col("_span.lo")) / bins
    place = F.when(width > 0, F.floor((F.col("score") - F.col("_span.lo")) / width)).otherwise(F.lit(0))
    return (long.withColumn("_span", span)
            .groupBy("method", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count("*").alias("n")))


def polarity_split(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Positive, neutral and negative counts and whole percentages per score column."""
    row = df.agg(F.count("*").alias("_total"), *[
        F.struct(F.count_if(F.col(c) > 0).alias("positive"), F.count_if(F.col(c) == 0).alias("neutral"),
                 F.count_if(F.col(c) < 0).alias("negative")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("s")) for c in columns]))
    flat = row.select("_total", rows.alias("r")).select("_total", "r.method", "r.s.*")
    return flat.select("method", "positive", "neutral", "negative", *[
        S.half_even(F.col(n) / F.col("_total") * 100).alias(f"{n}_pct")
        for n in ("positive", "neutral", "negative")])


def category_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts and whole percentages of several category columns in one pass."""
    long = df.select(*columns).unpivot([], list(columns), "category", "value")
    counts = long.groupBy("category", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("category").agg(F.sum("n").alias("_total"))
    return (counts.join(total, "category").filter(F.col("value").isNotNull())
            .select("category", "value", "n",
                    S.half_even(F.col("n") / F.col("_total") * 100).alias("pct")))


def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("_total"),
                 *[F.sum(F.col(f).cast("bigint")).alias(f) for f in flags])
    return (row.unpivot(["_total"], list(flags), "flag", "n")
            .select("flag", "n", S.half_even(F.col("n") / F.col("_total") * 100).alias("pct")))


def describe(df: DataFrame, column: str, places: int = 3) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum of one score, rounded at the end.

    The score is stored alone, so whatever computes it runs once."""
    df = store(df.select(column), "described")
    cuts = R.group_quantiles(df, [], [column], [0.25, 0.5, 0.75]).agg(F.max("q").alias("x")).scalar()
    row = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"),
                 F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    row = row.withColumn("_p", cuts).withColumns({"p25": F.col("_p")[0], "p50": F.col("_p")[1], "p75": F.col("_p")[2]})
    return row.select("count", *[S.half_even(F.col(c), places).alias(c)
                                 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def corpus_means(df: DataFrame, columns: Sequence[str], places: int = 3) -> DataFrame:
    row = df.agg(*[S.half_even(F.avg(c), places).alias(c) for c in columns])
    return row.unpivot([], list(columns), "metric", "value")


def yearly_breakdown(df: DataFrame, month: str = "month") -> DataFrame:
    """Reviews per year with the year's monthly counts in order, as ``'1,234, 987'``."""
    monthly = known_keys(df, [month]).groupBy(month).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct(month, "n")))
    return monthly.groupBy(F.year(month).alias("year")).agg(
        F.sum("n").alias("reviews"),
        F.array_join(F.transform(ordered, lambda m: F.format_number(m["n"], 0)), ", ").alias("monthly"))


def company_top(df: DataFrame, n: int = 5) -> DataFrame:
    """The largest companies with whole percentages, and how many companies there are in all."""
    counts = df.groupBy("company").agg(F.count("*").alias("reviews"))
    total = counts.agg(F.struct(
        F.sum("reviews").alias("total"), F.count("company").alias("companies"),
        F.array_join(F.array_sort(F.collect_list("company")), ", ").alias("names")).alias("x")).scalar()
    top = known_keys(counts, ["company"]).orderBy(F.desc("reviews"), "company").limit(n)
    return top.withColumn("_all", total).select(
        "company", "reviews", S.half_even(F.col("reviews") / F.col("_all.total") * 100).alias("pct"),
        "_all.companies", "_all.names")


def aspect_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return corpus_means(df, columns, 1).withColumnRenamed("metric", "aspect")


def annual_aspect_scores(df: DataFrame, aspects: Sequence[str], date: str = "month") -> DataFrame:
    """Wide aspect columns to long annual means; values that are not numbers are left out."""
    keys = [F.year(date).alias("year"), F.lower(F.trim("company")).alias("company"),
            F.lower(F.trim("product")).alias("product")]
    wide = df.select(*keys, *[F.col(f"{a}_sentiment_score").try_cast("double").alias(a) for a in aspects])
    long = wide.unpivot(["year", "company", "product"], list(aspects), "aspect", "score")
    ids = ["year", "company", "product", "aspect"]
    return known_keys(long, [*ids, "score"]).groupBy(*ids).agg(F.avg("score").alias("sentiment_score"))


def evidence_audit_grid(df: DataFrame, weight: str, threshold: float = dims.EVIDENCE_WEIGHT,
                        cap: int = 80) -> DataFrame:
    """Company x product: all reviews, those heavy enough, and how many of them may be used."""
    counts = df.groupBy("company", "product").agg(
        F.count("*").alias("total"), F.count_if(F.col(weight) >= threshold).alias("heavy"))
    grid = name_grid(counts, "company", "product")
    zero = F.lit(0).cast("bigint")
    return grid.join(counts, ["company", "product"], "left").select(
        "company", "product", F.coalesce("total", zero).alias("total_reviews"),
        F.coalesce("heavy", zero).alias("above_threshold"),
        F.least(F.coalesce("heavy", zero), F.lit(cap).cast("bigint")).alias("usable"))
