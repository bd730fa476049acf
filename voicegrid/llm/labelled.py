"""Labelled rows for fitting: all known labels or a bounded sample of them, and the features of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid.llm.common import fresh, steps, stored, with_columns_from_text
from voicegrid.llm.text_features import Features, Terms, distinct_terms, feature_arrays

FEATURES = T.ArrayType(T.DoubleType(), False)
SAMPLE = 20_000
FOLDS = 4
LEAST_EVIDENCE = 12.0
MOST_TERMS = 20_000


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_features(docs: DataFrame, text_col: str, learned: Terms | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a column of features, and its name. ``learned`` has terms found by ``telling_terms``."""
    name = fresh(docs, "features")

    def make():
        features = Features(learned=learned)
        return lambda column: feature_arrays(features, column)

    return with_columns_from_text(docs, text_col, [T.StructField(name, FEATURES, False)], make), name


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y`` of all labels that models may learn from. Null labels don't count; of a document with several
    labels the largest does."""
    return (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max(label).cast("double").alias("y")))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE,
                   id_col: str = "doc_id", text_col: str = "text", of_each: bool = False) -> DataFrame:
    """``doc_id, y, weight, text`` of at most ``sample`` labels' documents that aren't held out, stored.

    The sample is the labels with the smallest hashes; with ``of_each`` half of it may have each of the labels
    0 and 1, however rare, and ``weight`` tells how many labels of its kind a row stands for.
    """
    known = known_labels(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if of_each:
        half = sample // 2
        counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
        ones, zeros = (known.filter(F.col("y") == y).orderBy(*order).limit(half) for y in (1.0, 0.0))
        weight = {y: max(1.0, n / half) for y, n in counts.items()}
        some = ones.unionByName(zeros).withColumn("weight", F.when(F.col("y") == 1, weight.get(1.0, 1.0)).otherwise(weight.get(0.0, 1.0)))
    else:
        some = known.orderBy(*order).limit(sample).withColumn("weight", F.lit(1.0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")
    return stored(rows.select("doc_id", "y", "weight", "text"), "training")


def fold_of(text: str = "text", folds: int = FOLDS) -> Column:
    """The fold of a text, by its content: equal texts share one."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(5)), F.lit(folds)).cast("int")


def evidence(a: np.ndarray, b: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """The logarithm of how much better the share of label 1 among a term's own texts explains them than that
    among all texts does; 0 for terms of other texts. It grows with the number of texts, so that chance finds
    in few texts stay low at every size of the sample."""
    share, own = ones / max(1, ones + zeros), a / np.maximum(a + b, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(p / q), 0.0) for n, p, q in ((a, own, share), (b, 1 - own, 1 - share))]
    return np.where(own > share, parts[0] + parts[1], 0.0)


def telling_terms(rows: DataFrame, least: float = LEAST_EVIDENCE, most: int = MOST_TERMS, folds: int = FOLDS) -> list[Terms]:
    """Words and word beginnings that tell rows with ``y`` = 1 from the others, each with its weight.

    The first entries are learned without the texts of one fold each (see ``fold_of``), the last one from all
    texts. A term counts once per different text. It tells if its ``evidence`` is at least ``least``; its weight
    is the logarithm of its shrunken odds. Of more than ``most`` terms, those with the most evidence are taken.
    """
    texts = rows.filter("y IS NOT NULL").groupBy("text").agg(F.max("y").alias("y")).withColumn("fold", fold_of(folds=folds))
    held = np.zeros((folds, 2))
    for r in texts.groupBy("fold", "y").count().collect():
        held[r["fold"], int(r["y"] == 1)] += r["count"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                terms, docs = distinct_terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), *(part.column(c).take(pa.array(docs)) for c in ("y", "fold"))], ["term", "y", "fold"])

    sums = [F.sum(F.when(F.col("fold") == k, y)).alias(f"{n}{k}") for n, y in (("a", F.col("y")), ("b", 1 - F.col("y"))) for k in range(folds)]
    counts = texts.mapInArrow(work, "term bigint, y double, fold int").groupBy("term").agg(*sums).na.fill(0.0)
    some = sum(F.col(f"a{k}") for k in range(folds))
    # A term needs at least so many texts of label 1, and none of the other, for the least evidence.
    shares = [held[keep, 1].sum() / max(1.0, held[keep].sum()) for keep in ([k for k in range(folds) if k != without] for without in [*range(folds), None])]
    floor = min((least / -np.log(s) for s in shares if 0 < s < 1), default=0.0)
    ranked = counts.filter(some >= float(np.floor(floor))).orderBy(F.desc(some - sum(F.col(f"b{k}") for k in range(folds))), "term")
    found = ranked.limit(4 * most).toPandas()
    terms = found["term"].to_numpy(np.int64).view(np.uint64)
    a, b = (found[[f"{n}{k}" for k in range(folds)]].to_numpy(float) for n in "ab")
    out = []
    for without in [*range(folds), None]:
        keep = [k for k in range(folds) if k != without]
        ones, zeros, x, y = held[keep, 1].sum(), held[keep, 0].sum(), a[:, keep].sum(1), b[:, keep].sum(1)
        strength = evidence(x, y, ones, zeros)
        told = np.argsort(-strength, kind="stable")[:most]
        told = told[strength[told] >= least]
        told = told[np.argsort(terms[told])]
        weights = np.log((x[told] + 0.5) / (ones + 1)) - np.log((y[told] + 0.5) / (zeros + 1))
        out.append(Terms(terms[told], weights))
    return out
