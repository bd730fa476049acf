"""Reading review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voicegrid.schema import REVIEWS_CSV

# Doubled quotes inside fields, line breaks inside fields, and a leading byte-order mark.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def scan_reviews_csv(spark: SparkSession, path: str, schema: T.StructType = REVIEWS_CSV) -> DataFrame:
    """Read exported reviews with a declared schema.

    A file with line breaks in fields is read by one task; exports should come in many files.
    """
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def company_partition_read(spark: SparkSession, path: str, company: str,
                           department: str | None = None) -> DataFrame:
    """One company's reviews of a table partitioned by company; other folders are not listed.

    A department prefix narrows the company name, as in ``Services Acme``.
    """
    name = f"{department} {company}" if department else company
    return spark.read.parquet(path).filter(F.col("company") == name)
