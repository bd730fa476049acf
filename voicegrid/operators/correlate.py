"""Rank correlation and reordering of numeric tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.operators import rank as R
from voicegrid.session import store


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def _long_pairs(row: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row of pair structs to ``(col_a, col_b, ...)`` rows."""
    items = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                               *[F.col(f"{n}|{a}|{b}").alias(n) for n in names])
                      for a, b in _pairs(columns)])
    return row.select(F.explode(items).alias("_p")).select("_p.*")


def pearson_matrix(df: DataFrame, columns: Sequence[str], places: int = 6) -> DataFrame:
    """``(col_a, col_b, corr)`` of every pair, in one aggregate."""
    row = df.agg(*[F.bround(F.corr(a, b), places).alias(f"corr|{a}|{b}") for a, b in _pairs(columns)])
    return _long_pairs(row, columns, ["corr"])


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def average_ranks(df: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(key, <columns>)`` with every value replaced by its rank; equal values share their mean rank.

    Ranks are found per distinct value and joined back in long form. Values frequent enough to
    unbalance that join are a bounded list known from the quantiles: they are looked up by
    broadcast, all others by a shuffled join.
    """
    cuts = R.cut_points(df, columns)
    keys = _keys(key)
    long = R.long_values(df, columns, cuts, *keys).drop("region")
    ranks = R.distinct_positions(R.long_values(df, columns, cuts)).select(
        "series", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    heavy = F.lit(False)
    for c in columns:
        if cuts[c][1]:
            heavy = heavy | ((F.col("series") == c) & F.col("value").isin(list(cuts[c][1])))
    ids = ["series", "value"]
    ranked = (long.filter(~heavy).join(ranks.filter(~heavy), ids)
              .unionByName(long.filter(heavy).join(F.broadcast(ranks.filter(heavy)), ids)))
    return ranked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("series") == c, F.col("rank"))).alias(c) for c in columns])


def spearman_matrix(df: DataFrame, key: str | Sequence[str], columns: Sequence[str], places: int = 6) -> DataFrame:
    """``(col_a, col_b, corr)``: correlation of average ranks."""
    return pearson_matrix(average_ranks(df, key, columns), columns, places)


def column_ranks(df: DataFrame, key: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(key, series, rank)``: 1..n position of every row in each column, ties by key.

    Columns and keys may be of any type that has an order, and the key several columns.
    """
    return R.series_ranks(df, _keys(key), columns)


def linear_mix(df: DataFrame, key: str | Sequence[str], columns: Sequence[str],
               lower: Sequence[Sequence[float]]) -> DataFrame:
    """Multiply the row vector of scores by the transpose of a given lower-triangular factor."""
    def mixed(i: int) -> Column:
        total = F.lit(0.0)
        for j in range(i + 1):
            total = total + F.col(columns[j]) * float(lower[i][j])
        return total
    return df.select(*_keys(key), *[mixed(i).alias(c) for i, c in enumerate(columns)])


def rank_reorder(df: DataFrame, key: str | Sequence[str], columns: Sequence[str], scores: DataFrame) -> DataFrame:
    """``(key, <columns>)`` with each column's own values placed in the order of its scores.

    The row ranked k by score receives the k-th smallest value. All columns are ranked together, once by
    value and once by score; both ranks are gapless, so the join is one to one. Equal values may change
    places, so the values are ranked without the keys, of which a hash spreads them. A number stands for the
    keys of the scores until the end, and the columns are joined one after another, so that little is on
    disk at a time.
    """
    keys = _keys(key)
    rows = R.key_numbers(scores.select(*keys, *columns), keys)
    numbered = rows.select(F.col("_at").alias("_row"), *columns)
    by_score = R.numbered_ranks(numbered, ["_row"], columns, ["_row", "series"])
    spread = df.select(F.xxhash64(*keys).alias("_tie"), *columns)
    by_value = R.numbered_ranks(spread, ["_tie"], columns, ["series", "_value"])
    cells = None
    for i, c in enumerate(columns):
        score, value = (x.filter(F.col("series") == i).drop("series") for x in (by_score, by_value))
        placed = store(score.join(value, "rank").select("_row", F.col("_value").alias(c)), "placed")
        cells = placed if cells is None else cells.unionByName(placed, allowMissingColumns=True)
    cells = cells.groupBy("_row").agg(*[F.max(c).alias(c) for c in columns])
    # A left join to one row a number: the planner leaves it out where the keys are not asked for.
    named = rows.groupBy(F.col("_at").alias("_row")).agg(*[F.max(k).alias(k) for k in keys])
    return cells.join(named, "_row", "left").select(*keys, *columns)


def correlation_band(matrix: DataFrame) -> DataFrame:
    """Strength label of every pair."""
    r = F.col("corr")
    return matrix.withColumn("band", F.when(r > 0.5, "strong").when(r > 0, "mild")
                             .when(r < -0.5, "strong opposite").when(r < 0, "mild opposite")
                             .otherwise("independent"))


def matrix_gap(achieved: DataFrame, target: DataFrame) -> DataFrame:
    """Largest absolute difference between two long matrices over their pairs."""
    t = target.select("col_a", "col_b", F.col("corr").alias("_t"))
    return achieved.join(F.broadcast(t), ["col_a", "col_b"]).agg(
        F.max(F.abs(F.col("corr") - F.col("_t"))).alias("max_abs_gap"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float, stored: bool = False) -> DataFrame:
    """One row with the linearly interpolated quantile of each column (see ``rank.group_quantiles``)."""
    found = R.group_quantiles(df, [], columns, [q], stored)
    return found.agg(*[F.max(F.when(F.col("series") == c, F.col("q")[0])).alias(c) for c in columns])


def co_exceedance(before: DataFrame, after: DataFrame, columns: Sequence[str], q: float = 0.9,
                  places: int = 6) -> DataFrame:
    """How often both columns of a pair exceed the q-quantile of the *after* table, in each table.

    The *after* table is usually the end of a long plan and is read three times, so its columns are stored.
    """
    after = store(after.select(*columns), "after")
    cuts = exact_quantiles(after, columns, q, stored=True).select(F.struct(*columns).alias("x")).scalar()
    def shares(df: DataFrame, name: str) -> DataFrame:
        row = df.withColumn("_q", cuts).agg(*[
            F.avg(((F.col(a) > F.col(f"_q.{a}")) & (F.col(b) > F.col(f"_q.{b}"))).cast("double"))
            .alias(f"{name}|{a}|{b}") for a, b in _pairs(columns)])
        return _long_pairs(row, columns, [name])
    both = shares(before, "before").join(shares(after, "after"), ["col_a", "col_b"])
    return both.select("col_a", "col_b", F.bround("before", places).alias("before"),
                       F.bround("after", places).alias("after"),
                       F.bround(F.col("after") - F.col("before"), places).alias("change"))


def marginal_summary(df: DataFrame, columns: Sequence[str], places: int = 0) -> DataFrame:
    """Mean, population deviation, minimum and maximum per column."""
    stats: Mapping[str, object] = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    row = df.agg(*[F.bround(f(c), places).alias(f"{n}|{c}") for c in columns for n, f in stats.items()])
    items = F.array(*[F.struct(F.lit(c).alias("series"), *[F.col(f"{n}|{c}").alias(n) for n in stats])
                      for c in columns])
    return row.select(F.explode(items).alias("_s")).select("_s.*")


def trend_line(df: DataFrame, x: str, y: str, places: int = 6) -> DataFrame:
    """Slope and intercept of the least-squares line of y on x."""
    return df.agg(F.bround(F.regr_slope(y, x), places).alias("slope"),
                  F.bround(F.regr_intercept(y, x), places).alias("intercept"))
