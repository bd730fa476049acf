"""Filters and hygiene steps on review tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from voicegrid import dims
from voicegrid.functions import dates as D, words as W
from voicegrid.schema import CANONICAL_NAMES


def normalize_headers(df: DataFrame, names: Mapping[str, str] = CANONICAL_NAMES) -> DataFrame:
    """Trim column names and rename known spellings to the canonical ones."""
    return df.toDF(*[names.get(c.strip(), c.strip()) for c in df.columns])


def default_column(df: DataFrame, name: str, value, dtype: str = "string") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value).cast(dtype))


def drop_null_essential(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_blank_text(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(F.length(F.trim(c)) > 0)
    return df


def drop_invalid_dates(df: DataFrame, column: str, out: str | None = None,
                       formats: Sequence[str] = D.DAY_FIRST) -> DataFrame:
    out = out or column
    return df.withColumn(out, D.parse_lenient(F.col(column), formats)).filter(F.col(out).isNotNull())


def parse_date_majority(df: DataFrame, column: str, out: str) -> DataFrame:
    """Day-first dates, or month-first for the whole table when more than half do not parse.

    The choice is a scalar subquery, computed once.
    """
    day_first = D.parse_lenient(F.col(column), ("d/M/yyyy", "d-M-yyyy"))
    month_first = D.parse_lenient(F.col(column), ("M/d/yyyy", "M-d-yyyy", "yyyy-MM-dd"))
    mostly_failed = df.agg((F.count_if(day_first.isNull()) * 2 > F.count("*")).alias("x")).scalar()
    return df.withColumn(out, F.when(mostly_failed, month_first).otherwise(day_first))


def min_length_filter(df: DataFrame, column: str, chars: int = dims.MIN_REVIEW_CHARS) -> DataFrame:
    return df.filter(F.length(F.coalesce(F.col(column), F.lit(""))) >= chars)


def dedup_exact_keep_first(df: DataFrame, text: str, *order: str) -> DataFrame:
    """Keep the first row of every distinct text (NULL counts as one text), in the order of all ``order`` columns.

    Only a digest and the key are shuffled to find the first rows, pre-aggregated per task, so
    a text with very many copies costs one partial row per task; the full rows are then kept
    by a semi join on order and digest. Rows equal in both stay together.
    """
    marked = df.withColumn("_digest", F.sha2(F.col(text), 256))
    first = marked.groupBy(F.col("_digest").alias("_of")).agg(F.min(F.struct(*order)).alias("_first"))
    same = [marked[c].eqNullSafe(first["_first"][c]) for c in order]
    return marked.join(first, [marked["_digest"].eqNullSafe(first["_of"]), *same], "left_semi").drop("_digest")


def data_quality_report(df: DataFrame, date_text: str, review: str,
                        chars: int = dims.MIN_REVIEW_CHARS) -> DataFrame:
    """Loaded, bad-date, short and kept row counts and the share kept, in one pass."""
    bad = D.parse_lenient(F.col(date_text)).isNull()
    short = ~bad & (F.length(F.coalesce(F.col(review), F.lit(""))) < chars)
    counts = df.agg(F.count("*").alias("loaded"), F.count_if(bad).alias("invalid_date"),
                    F.count_if(short).alias("too_short"))
    kept = F.col("loaded") - F.col("invalid_date") - F.col("too_short")
    return counts.select("loaded", "invalid_date", "too_short", kept.alias("kept"),
                         F.when(F.col("loaded") > 0, F.bround(kept / F.col("loaded") * 100, 1))
                         .otherwise(F.lit(0.0)).alias("quality_pct"))


def year_filter(df: DataFrame, column: str, year: int | None) -> DataFrame:
    """Rows of one year, as a date range that scans can prune on; None keeps every row."""
    if year is None:
        return df
    return df.filter(F.col(column).between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))


def date_range_filter(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Rows within the requested window after clamping it to the dates that occur.

    The bounds are scalar subqueries, which the scan can use to skip files.
    """
    first = df.agg(F.greatest(F.min(column), F.lit(start)).alias("x")).scalar()
    last = df.agg(F.least(F.max(column), F.lit(end)).alias("x")).scalar()
    return df.filter((F.col(column) >= first) & (F.col(column) <= last))


def provider_in_filter(df: DataFrame, column: str, chosen: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(chosen)))


def company_product_filter(df: DataFrame, company: str, product: str) -> DataFrame:
    return df.filter((F.col("company") == company) & (F.col("product") == product))


def regex_contains_filter(df: DataFrame, column: str, pattern: str | None, literal: bool = False) -> DataFrame:
    """Case-sensitive search; without a pattern every row stays."""
    if pattern is None:
        return df
    found = F.contains(F.col(column), F.lit(pattern)) if literal else F.col(column).rlike(pattern)
    return df.filter(found)


def exclude_unknown(df: DataFrame, column: str, unknown: str = "Unknown") -> DataFrame:
    """Drop one category; rows without a category stay."""
    return df.filter(~F.col(column).eqNullSafe(unknown))


def weight_threshold_filter(df: DataFrame, column: str = "review_weight",
                            threshold: float = dims.EVIDENCE_WEIGHT) -> DataFrame:
    return df.filter(F.col(column) >= threshold)


def mention_filter(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    return df.filter(W.has_substring(F.col(text), keywords))


def head_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def distinct_options(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()

