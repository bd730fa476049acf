"""From raw documents to packed training sequences: five stages, each stored before the next one reads it.

Every stage takes rows without an id or a text, empty and very long texts, repeated rows, further columns of
any name and empty tables. All but the last return the columns they got; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid.llm.decontaminate import without_benchmark
from voicegrid.llm.line_dedup import without_repeated_lines
from voicegrid.llm.ngram_join import without_near_duplicates
from voicegrid.llm.packing import packed_documents
from voicegrid.llm.tokens import default_tokenizer
from voicegrid.llm.toxicity import without_toxic
from voicegrid.session import work_dir
from voicegrid.sources.reviews import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. Rows are judged one by one: repeated ones alike, null and empty texts by
    the features of an empty text."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut; documents that lose all their text this way go.

    Null texts stay null and empty ones empty. Rows equal in id and text are one document: they stay or are cut
    alike. Documents without an id come after the others."""
    out, lines, _ = without_repeated_lines(docs)
    text = F.col("text")
    kept = out.filter((F.col(lines) == 0) | (F.length(F.trim(text)) > 0))
    sized = F.when(F.col(lines) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", sized).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, repeated rows included; rows without any word all stay."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; those without words stay."""
    return without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids in sequences, one row per piece. Repeated rows are packed each; null and empty texts have the
    end id alone."""
    return packed_documents(docs, default_tokenizer(), capacity=4096, end_id=2)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontamination", decontamination), ("packing", packing)]

# A trained model, automata and a packing heuristic: not expressible in SQL (see tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
