"""Declared table schemas and the column contract check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Column order and spelling are fixed by the exchange files.
REVIEWS_CSV = T.StructType([
    T.StructField("Date", _S), T.StructField("Rating", _I), T.StructField("Title", _S),
    T.StructField("Review", _S), T.StructField("Company", _S),
])

SUMMARY = _struct(Year=_I, Product=_S, Aspect=_S, Analysis=_S)

RUN_LOG = _struct(
    input_file=_S, output_file=_S, run_date=T.TimestampType(), total_rows=_L,
    rows_processed=_L, analyses=_S, model=_S, temperature=_D, max_tokens=_I, seconds=_D,
)

ISSUES = T.StructType([T.StructField("issues", T.ArrayType(_struct(
    summary=_S, bg_quote=_S, competitor_quote=_S, explanation=_S, action=_S)))])

# Spelling variants of the review columns and the names used throughout this package.
CANONICAL_NAMES = {
    "Date": "date", "Review": "review", "Company": "company", "Product": "product",
    "Final Product Category": "product", "prod_category": "product",
    "Year-Month": "month", "Rating": "rating", "Title": "title",
}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns that ``df`` lacks; looks at the schema only, so it starts no job."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def contract_check(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail with every missing column named."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
