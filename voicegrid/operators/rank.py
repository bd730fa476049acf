"""Ranking, top-n, sampling, evidence assembly and global order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrid import dims
from voicegrid.session import store


# -- global order without a single-task window ---------------------------------------------


# Per column: the edges of its value ranges, and how many ranges each heavy value would fill.
Cuts = dict[str, tuple[list[float], dict[float, int]]]


def cut_points(df: DataFrame, columns: Sequence[str], regions: int | None = None) -> Cuts:
    """Per column: region edges and the heavy values among them, from approximate quantiles.

    One pass over the data brings ``regions`` numbers per column to the driver. A value that is
    returned for two neighbouring quantiles holds about ``1/regions`` of the rows or more.
    """
    regions = regions or _regions(df)
    probs = [i / regions for i in range(1, regions)]
    out = {}
    for c, q in zip(columns, df.approxQuantile(list(columns), probs, 1 / (4 * regions))):
        out[c] = sorted(set(q)), {v: n for v, n in Counter(q).items() if n > 1}
    return out


def _regions(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def add_region(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """Number of the value range a row falls in; a later range holds only larger values."""
    df = df.withColumn("_x", F.col(column).cast("double"))
    if not edges:
        return df.withColumn(out, F.lit(0.0)).drop("_x")
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *edges, inf], inputCol="_x", outputCol=out, handleInvalid="keep")
    return cut.transform(df).drop("_x")


def _offsets(counted: DataFrame, regions: Sequence[str], n: str, out: str) -> DataFrame:
    """Rows before each region. ``counted`` has one row per region, so the window is small."""
    w = Window.orderBy(*regions).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0))).drop(n)


def positions(df: DataFrame, order: Sequence[str], out: str = "position", keep: Sequence[str] | None = None) -> DataFrame:
    """Exact 0-based position of every row in the order of some columns, of whatever types.

    Rows are range partitioned in that order, so cut points come from a sample in the columns' own
    order, and numbered within their range. The result (all columns, or those of ``keep``) is stored
    once, because the numbers of rows before each range are added afterwards: those are one row per
    range. ``order`` should tell rows apart (end it with the key): equal rows cannot be spread over ranges.
    """
    ranged = (df.repartitionByRange(_regions(df), *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    kept = store(ranged.select(*(keep or df.columns), "_at"), "positions")  # sorted by one job; a checkpoint would sort twice
    # The range is in the upper bits of the number, the place in it below.
    placed = kept.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    placed = placed.join(F.broadcast(store(_offsets(counts, ["_range"], "_n", "_before"), "offsets")), "_range")
    return placed.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_range", "_before", "_at")


def key_numbers(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All columns and ``_at``, stored: a number that grows with the keys, the same for equal keys, with gaps.

    It stands for the keys, whatever their number and types, where rows are sorted, joined and grouped by them.
    Equal keys meet in one range.
    """
    ranged = (df.repartitionByRange(_regions(df), *keys).sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    return store(ranged.withColumn("_at", F.min("_at").over(Window.partitionBy(*keys))), "keys")


def numbered_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep, rank)``: as ``series_ranks``, with ``series`` the number of the column and ``_value`` the value;
    the columns are of one type, and ``keep`` names those of ``keys``, ``series`` and ``_value`` that are wanted."""
    cells = F.array(*[F.struct(F.lit(i).alias("series"), F.col(c).alias("_value")) for i, c in enumerate(columns)])
    long = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").filter(F.col("_value").isNotNull())
    placed = positions(long, ["series", "_value", *keys], "_position", keep)
    sizes = store(_offsets(long.groupBy("series").agg(F.count("*").alias("_n")), ["series"], "_n", "_first"), "offsets")
    return placed.join(F.broadcast(sizes), "series").select(*keep, (F.col("_position") - F.col("_first") + 1).alias("rank"))


def series_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys, series, rank)``: 1..n rank of every row in each column by value and keys, NULLs left out.

    All columns of one type are one long table in one global order, whatever their number; a column's
    ranks begin after the rows of the columns before it.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = None
    for some in kinds.values():
        ranked = numbered_ranks(df, keys, some, [*keys, "series"])
        ranked = ranked.withColumn("series", F.array(*map(F.lit, some))[F.col("series")])
        out = ranked if out is None else out.unionByName(ranked)
    return out


def long_values(df: DataFrame, columns: Sequence[str], cuts: Cuts, *keys: str) -> DataFrame:
    """``(keys, series, region, value)``: the columns as one long table, NULLs left out.

    Ranges are looked up in the wide table, so all columns share one pass.
    """
    for i, c in enumerate(columns):
        df = add_region(df, c, cuts[c][0], f"_region{i}")
    cells = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"_region{i}").alias("region"),
                               F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").dropna(subset=["value"])


def distinct_positions(long: DataFrame, *groups: str) -> DataFrame:
    """``(groups, series, value, n, before)``: every distinct value of each column of ``long_values``, per
    group how many rows hold it and how many hold a smaller one. Values are counted map-side before
    they are moved, and no group's values gather in one task."""
    keys = [*groups, "series"]
    counts = long.groupBy(*keys, "region", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys, "region").agg(F.sum("n").alias("_n"))
    earlier = (Window.unboundedPreceding, -1)
    w = Window.partitionBy(*keys).orderBy("region").rowsBetween(*earlier)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "region").orderBy("value").rowsBetween(*earlier)
    # Without groups a row per range and column; with groups the planner decides by the measured size.
    totals = totals if groups else F.broadcast(totals)
    return (counts.join(totals, [*keys, "region"])
            .withColumn("before", F.col("_before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
            .select(*keys, "value", "n", "before"))


def group_quantiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], probs: Sequence[float],
                    stored: bool = False) -> DataFrame:
    """``(groups, series, n, q)``: the linearly interpolated quantiles of each column in each group, exactly.

    The order statistics around each position are read off the running counts of distinct values within
    value ranges, so no group's values stand in one list or buffer, however many different ones it has.
    NULLs are left out; a group without values of a column has no row for it. Group keys must not be NULL.
    ``stored`` tells that the table is stored already; otherwise its values are, as they are read several times.
    """
    df = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    df = df.dropna(subset=list(groups)) if groups else df
    df = df if stored else store(df, "values")  # written by one job; a checkpoint would run the plan twice
    keys = [*groups, "series"]
    values = distinct_positions(long_values(df, columns, cut_points(df, columns), *groups), *groups)
    totals = values.groupBy(*keys).agg(F.sum("n").alias("_total"))
    placed = values.join(totals if groups else F.broadcast(totals), keys)

    def at(prob: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(prob))

    def holds(position: Column) -> Column:
        return (F.col("before") <= position) & (position < F.col("before") + F.col("n"))

    sides = [side(at(p)) for p in probs for side in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for position in sides:
        wanted = wanted | holds(position)
    found = placed.filter(wanted).groupBy(*keys).agg(
        F.max("_total").alias("_total"), *[F.max(F.when(holds(position), F.col("value"))).alias(f"_v{i}") for i, position in enumerate(sides)])
    cells = [F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) * (at(p) - F.floor(at(p))) for i, p in enumerate(probs)]
    return found.select(*keys, F.col("_total").alias("n"), F.array(*cells).alias("q"))


def fixed_size_batches(df: DataFrame, key: str | Sequence[str], size: int) -> DataFrame:
    """``batch`` from 0 and 1-based ``index_in_batch`` in the order of one or more key columns of any type."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = positions(df.dropna(subset=keys), keys, "_position")
    return (ranked.withColumn("batch", F.floor(F.col("_position") / size))
            .withColumn("index_in_batch", (F.pmod(F.col("_position"), F.lit(size)) + 1)).drop("_position"))


# -- top n per group -------------------------------------------------------------------------


TOP_N_PARTS = 256


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank: str | None = None) -> DataFrame:
    """First n rows of every group.

    The optimizer cuts each task's rows to n per group before the shuffle, so a group holding much
    of the table is never gathered. It does so up to a limit; for a larger n every group is first
    cut to the n best of each of ``TOP_N_PARTS`` parts.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(TOP_N_PARTS)).alias("_part")
        parts = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (df.withColumn("_part", part).withColumn("_n", F.row_number().over(parts))
              .filter(F.col("_n") <= n).drop("_part", "_n"))
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def topn_by_weight(df: DataFrame, n: int, weight: str = "review_weight", key: str = "review_id",
                   groups: Sequence[str] = ("company", "product")) -> DataFrame:
    return top_n(df, groups, [F.desc(weight), F.col(key)], n, "rank")


def balanced_topn(df: DataFrame, primary: str, competitor: str, cap: int, weight: str = "review_weight",
                  key: str = "review_id", threshold: float = dims.EVIDENCE_WEIGHT) -> DataFrame:
    """Per product equally many heaviest reviews of both companies: the smaller side, at most cap."""
    both = df.filter(F.col("company").isin(primary, competitor) & (F.col(weight) >= threshold))
    # The ranks are cut at the cap, so what is left of each side tells how many it can give.
    ranked = topn_by_weight(both, cap, weight, key)
    sides = Window.partitionBy("product")
    take = F.least(*[F.count_if(F.col("company") == c).over(sides) for c in (primary, competitor)])
    return ranked.withColumn("take", take).filter(F.col("rank") <= F.col("take"))


def recent_n(df: DataFrame, primary: str, limit: int = 50, key: str = "review_id",
             groups: Sequence[str] = ("year", "product")) -> DataFrame:
    """Most recent reviews per group for the primary company and for all others together.

    ``limit`` is split in half between the sides; an odd one goes to the primary side.
    """
    sided = df.withColumn("side", F.when(F.col("company") == primary, "primary").otherwise("market"))
    half, extra = limit // 2, limit % 2
    ranked = top_n(sided, [*groups, "side"], [F.desc("date"), F.col(key)], half + extra, "rank")
    return ranked.filter(F.col("rank") <= F.when(F.col("side") == "primary", half + extra).otherwise(half))


def topn_by_relevance(df: DataFrame, aspects: Sequence[str], n: int, key: str = "review_id") -> DataFrame:
    """Per company and aspect the n reviews that name the aspect most."""
    named = df.select(key, "company", *[F.col(f"relevance_{a}").alias(a) for a in aspects])
    long = named.unpivot([key, "company"], list(aspects), "aspect", "relevance").filter("relevance > 0")
    return top_n(long, ["company", "aspect"], [F.desc("relevance"), F.col(key)], n, "rank")


def proportional_month_sample(df: DataFrame, limit: int = 50, seed: int = 42, key: str = "review_id",
                              month: str = "month") -> DataFrame:
    """A seeded sample with each month's quota cut down from its share of the limit.

    Months are a calendar, so their quotas are broadcast.
    """
    counts = df.groupBy(month).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("x")).scalar()
    quota = counts.select(month, (F.col("_n") / total * limit).cast("int").alias("quota"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranked = top_n(df.withColumn("_draw", draw), [month], [F.col("_draw"), F.col(key)], limit, "rank")
    return ranked.join(F.broadcast(quota), month).filter(F.col("rank") <= F.col("quota")).drop("_draw")


def chronological_sort(df: DataFrame, date: str, *ties: str) -> DataFrame:
    return df.orderBy(date, *ties)


def last_k(df: DataFrame, order: str, k: int) -> DataFrame:
    """The k greatest rows by one column, in ascending order."""
    return df.orderBy(F.desc(order)).limit(k).orderBy(order)


# -- evidence text -----------------------------------------------------------------------------


def numbered_evidence_text(ranked: DataFrame, keys: Sequence[str], text: str = "review",
                           rank: str = "rank", label: Column | None = None) -> DataFrame:
    """``Review i (label): text`` lines per group. Takes ranked top-n rows, so groups are small."""
    suffix = F.lit("") if label is None else F.concat(F.lit(" ("), label, F.lit(")"))
    line = F.concat(F.lit("Review "), F.col(rank).cast("string"), suffix, F.lit(": "), F.trim(text))
    lines = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("i"), line.alias("line"))))
    return ranked.groupBy(*keys).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("evidence"))


def side_by_side_context(ranked: DataFrame, primary: str, competitor: str, key: str = "product",
                         text: str = "review", rank: str = "rank") -> DataFrame:
    """Both companies' ranked reviews under headings with their number."""
    def side(company: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(
            F.col("company") == company, F.struct(F.col(rank).alias("i"), F.col(text).alias("t")))))
        return F.concat(F.lit(f"{company} Reviews ("), F.size(rows).cast("string"), F.lit("):\n"),
                        F.array_join(F.transform(rows, lambda r: r["t"]), " "))
    return ranked.groupBy(key).agg(
        F.concat(side(primary), F.lit("\n\n"), side(competitor)).alias("context"))
