"""Exact duplicates: groups by a 128-bit content hash, confirmed by comparing bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.llm.common import BROADCAST_ROWS, ascii_lower, lookup, stored


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 normalise: Callable[[Column], Column] = ascii_lower,
                 digest: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when their normalised bytes are; null counts as empty. Of a group the row with the
    largest id stays (``keep="min"``: the smallest); null ids come last, and of repeated rows with the id
    that stays one stays. Digests are grouped first. Only texts whose digest repeats are moved, once per
    task and text, and compared as bytes: a group of the digest that holds several texts is cut by them.
    Extra columns are ignored.
    """
    body = normalise(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    rows = stored(source.select("doc_id", digest(F.col("body")).alias("digest"), F.sha2("body", 256).alias("text_sha256"))
                  .withColumn("row", F.monotonically_increasing_id()), "digests")
    repeated = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    texts = (source.withColumn("digest", digest(F.col("body"))).join(repeated, "digest", "left_semi")
             .groupBy("digest", "body").agg(F.count(F.lit(1)).alias("copies")))
    # One row per different text inside a repeated digest; its SHA-256 names it from here on.
    confirmed = stored(texts.select("digest", F.sha2("body", 256).alias("text_sha256"), "copies"), "texts")
    double = confirmed.groupBy("digest", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if double.limit(1).count():
        raise ValueError("two different texts agree in both digests")
    rank = F.struct(F.col("doc_id").isNotNull(), "doc_id", "row") if keep == "max" else F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    best = F.max(rank) if keep == "max" else F.min(rank)
    # Row numbers are compared only among rows of one id, so any of them will do.
    keepers = (rows.groupBy("digest", "text_sha256").agg(best.alias("best"))
               .join(confirmed.filter("copies > 1"), ["digest", "text_sha256"]))
    table = stored(keepers.select("digest", "text_sha256", F.col("best.doc_id").alias("keep_id"),
                                  F.col("best.row").alias("keep_row"), "copies"), "keepers")
    found = lookup(rows, table, ["digest", "text_sha256"], "copies")
    alone = F.col("copies").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")
