"""Mixtures of sources by weight: whole epochs of each source, then a weighted random sample without replacement.

The sample is that of Efraimidis and Spirakis: a document of quality weight ``w`` gets the key ``-ln(u) / w``
with ``u`` from a hash of its id, documents are sorted by key within their source, and the sizes are summed
in that order until the words that the source still lacks are reached. The document there is taken in part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from voicegrid.llm import bytewords
from voicegrid.llm.common import fresh, lookup, stored, text_buffers, with_columns_from_text

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
KEYS_PER_RANGE = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True


def with_sizes(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the number of words between ASCII white space, and a quality weight above 0 up to 1.

    The weight is the squared share of letters among the visible characters, where every character beyond
    ASCII counts as a letter: tables, code, markup and numbers weigh less than prose. Null and empty texts
    have no words and the weight 1. The names of the new columns are returned too.
    """
    size, quality = fresh(docs, "size"), fresh(docs, "quality_weight")

    def make():
        def measure(texts: pa.Array) -> list[pa.Array]:
            data, begins = text_buffers(texts)
            words = bytewords.cut(data, begins, bytewords.NOT_SPACE)
            heads = (data & 0xC0) != 0x80  # the first byte of each character
            visible, letters = (np.r_[0, np.cumsum(heads & mask[data])][begins] for mask in (bytewords.NOT_SPACE, _LETTER))
            share = np.maximum(np.diff(letters), 1) / np.maximum(np.diff(visible), 1)
            return [pa.array(words.counts.astype(np.int64)), pa.array(share * share)]
        return measure

    fields = [T.StructField(size, T.LongType()), T.StructField(quality, T.DoubleType())]
    return with_columns_from_text(docs, text_col, fields, make), size, quality


def draw_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """The exponential key of a document; the same in every run. Null and repeated ids share their ``u``."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` (one row per source) with ``target, epochs, rest``.

    Sources in the order of their code points, null last, weigh ``weights``, repeating, and share the sum of
    all sizes. A target stops at ``most`` times its source's size; what is above goes to the others by
    weight until none is above. The sources are sorted by the level at which they stop: a source stops when
    that level is not above the one that all sources from it on would share.
    """
    size = F.col("source_size")
    every = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(every) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", most * size / F.col("weight"))
    before = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(size).over(whole) - F.coalesce(F.sum(most * size).over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / weight)
    stops = F.col("stop") <= F.col("level")
    shared = F.min(F.when(~stops, F.struct("stop", F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    target = F.when(stops, (most * size).cast("double")).otherwise(shared * F.col("weight"))
    planned = leveled.withColumn("target", target)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(size > 0, F.floor(budget / size)).otherwise(F.lit(0)).cast("bigint")
    return planned.withColumn("epochs", epochs).select(
        "source", "source_size", "target", "epochs", (budget - F.col("epochs") * size).alias("rest"))


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, cut, part_words, cut_words`` for sources with a rest: the key at which the rest is reached.

    Equal keys are summed first. The keys are range partitioned by source and key, so that a large source
    spreads over many tasks; each task sums the sizes of its sources, and the sums of earlier ranges are added.
    """
    spark = sized.sparkSession
    keys = stored(sized.filter("size > 0").groupBy("source", "key").agg(F.sum("size").alias("held")), "keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // KEYS_PER_RANGE))
    order = [F.col("source").asc_nulls_last(), F.col("key")]
    schema = T.StructType([*keys.schema.fields, T.StructField("through", T.LongType()), T.StructField("part", T.IntegerType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = object(), 0
        for batch in batches:
            held = batch.column("held").to_numpy()
            ends = np.cumsum(held)
            names = batch.column("source").dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy()
            begins = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1] if len(code) else np.zeros(0, int)
            offset = np.zeros(len(code), np.int64)
            for k, begin in enumerate(begins):
                name = batch.column("source")[int(begin)].as_py()
                end = begins[k + 1] if k + 1 < len(begins) else len(code)
                base = ends[begin] - held[begin]
                offset[begin:end] = (total if name == last else 0) - base
                last, total = name, int(ends[end - 1] + offset[end - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends + offset), batch.column("part")], schema.names)

    ranges = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    summed = stored(ranges.mapInArrow(sums, schema), "prefix-sums")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (summed.groupBy("source", "part").agg(F.max("through").alias("all"))
               .withColumn("earlier", F.coalesce(F.sum("all").over(earlier), F.lit(0))))
    # One row per source and range: a range holds a source's rows only where it begins, ends or fills it.
    wanted = offsets.join(targets.filter("rest > 0"), offsets["source"].eqNullSafe(targets["source"])).filter(
        "earlier < rest AND earlier + all >= rest").select(offsets["source"].alias("wanted_source"), F.col("part").alias("wanted_part"), "earlier", "rest")
    at = summed.join(wanted, F.col("source").eqNullSafe(F.col("wanted_source")) & (F.col("part") == F.col("wanted_part")))
    reached = F.col("earlier") + F.col("through")
    return at.filter((reached >= F.col("rest")) & (reached - F.col("held") < F.col("rest"))).select(
        "source", F.col("key").alias("cut"), (F.col("rest") - reached + F.col("held")).alias("part_words"), F.col("held").alias("cut_words"))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 11, id_col: str = "doc_id",
            source_col: str = "source", size_col: str = "size", weight_col: str = "quality_weight") -> DataFrame:
    """One row per row: ``doc_id, source, size, source_size, target, epochs, part_words, taken``.

    ``epochs`` is how often the whole document is taken, ``part_words`` how many of its first words once
    more, ``taken`` the words of both. A source takes its target's nearest whole number of words, up to
    rounding within documents of equal keys: these share what is left in proportion to their sizes, so that
    repeated rows are treated alike. Sources without words get the target 0. Missing sizes count as 0,
    missing or non-positive weights as the smallest positive one. Any number of sources is allowed; all
    that one task holds of them is a row per source.
    """
    weight = F.greatest(F.coalesce(F.col(weight_col), F.lit(0.0)), F.lit(1e-12))
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size_col, F.lit(0)).cast("bigint").alias("size"),
                               draw_key(F.col(id_col), weight, seed).alias("key")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("copies"))
    targets = stored(source_targets(sources.drop("copies"), weights, most), "targets")
    cuts = _cuts(sized, targets)
    plan = targets.join(cuts, targets["source"].eqNullSafe(cuts["source"]), "left").drop(cuts["source"])
    plan = plan.join(sources.select(F.col("source").alias("counted"), "copies"), F.col("source").eqNullSafe(F.col("counted"))).drop("counted")
    # A null source joins as a source of its own: its key says whether it is null.
    none, name = F.col("source").isNull(), F.coalesce("source", F.lit(""))
    plan = stored(plan.select(none.alias("none"), name.alias("name"), "source_size", "target", "epochs", "cut", F.col("part_words").alias("left_words"), "cut_words", "copies"), "plan")
    rows = lookup(sized.withColumns({"none": none, "name": name}), plan, ["none", "name"], "copies")
    share = F.expr("CAST(size AS DECIMAL(20, 0)) * CAST(left_words AS DECIMAL(18, 0)) div cut_words")
    once = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), share).otherwise(F.lit(0))
    return (rows.withColumn("part_words", F.coalesce(once, F.lit(0)).cast("bigint"))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part_words"))
            .select("doc_id", "source", "size", "source_size", "target", "epochs", "part_words", "taken"))
