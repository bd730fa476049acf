"""Writing review tables, reports and run logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voicegrid.schema import RUN_LOG


def write_per_company(df: DataFrame, path: str, column: str = "company",
                      rows_per_file: int = 1_000_000) -> None:
    """One folder per company.

    Tasks write their own files, so a company with most of the rows is spread over many tasks;
    the files it gets are cut at ``rows_per_file``.
    """
    (df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
     .partitionBy(column).parquet(path))


def report_columns(df: DataFrame, order: Sequence[str], places: int = 2,
                   date_format: str = "yyyy-MM") -> DataFrame:
    """Report columns in order: decimals with fixed places, dates as text, the rest unchanged."""
    types = {f.name: f.dataType for f in df.schema}

    def shown(name: str) -> Column:
        c = F.col(name)
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            return F.when(c.isNotNull(), F.format_string(f"%.{places}f", F.bround(c, places)))
        if isinstance(types[name], (T.DateType, T.TimestampType)):
            return F.date_format(c, date_format)
        return c
    return df.select(*[shown(n).alias(n) for n in order if n in types])


def write_report_csv(df: DataFrame, path: str, order: Sequence[str], places: int = 2,
                     date_format: str = "yyyy-MM") -> None:
    report_columns(df, order, places, date_format).write.mode("overwrite").options(
        header="true", quote='"', escape='"').csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add a batch of result rows to a results table."""
    df.write.mode("append").parquet(path)


def resume_unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the stored results."""
    return df.join(done.select(key), key, "left_anti")


def run_log_append(spark: SparkSession, path: str, input_file: str, output_file: str, total_rows: int,
                   rows_processed: int, analyses: Sequence[str], model: str, temperature: float,
                   max_tokens: int, seconds: float) -> None:
    """Add one audit row for a finished run."""
    row = (input_file, output_file, datetime.now(timezone.utc), total_rows, rows_processed,
           ", ".join(analyses), model, temperature, max_tokens, seconds)
    spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").parquet(path)
