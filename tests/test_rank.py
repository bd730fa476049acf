"""Ranks, samples and rank correlation, with ties, hot values and different partitionings."""

import os
import random
import time
from datetime import date
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voicegrid.operators import correlate as Q, rank as R
from voicegrid.session import FREE_SHUFFLES, store


def skewed(spark, n=3000, seed=7):
    """A third of the rows share one value; others repeat now and then."""
    rng = random.Random(seed)
    rows = [(i * 7 % n, 5.0 if i % 3 == 0 else float(rng.randint(0, 200)), rng.random(), float(rng.randint(0, 3)))
            for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double"), pd.DataFrame(rows, columns=list(["id", "a", "b", "c"]))


def test_column_ranks_with_hot_values(spark):
    df, pdf = skewed(spark)
    got = {(r.series, r.id): r["rank"] for r in Q.column_ranks(df, "id", ["a", "b", "c"]).collect()}
    for column in "abc":
        order = pdf.sort_values([column, "id"]).id.tolist()
        assert [got[column, k] for k in order] == list(range(1, len(order) + 1))


def test_a_hot_value_spreads_over_ranges(spark):
    df, _ = skewed(spark)
    ranged = df.repartitionByRange(8, "a", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 3000 / 3
    placed = R.positions(df, ["a", "id"])
    assert sorted(r.position for r in placed.select("position").collect()) == list(range(3000))


def test_ranks_do_not_depend_on_partitioning(spark):
    df, _ = skewed(spark)
    one = Q.column_ranks(df.repartition(1), "id", ["a", "b"])
    many = Q.column_ranks(df.repartition(13), "id", ["a", "b"])
    assert one.exceptAll(many).count() == 0


def test_ranks_of_every_type_and_composite_keys(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), f"k{rng.randrange(40)}", i, rng.choice(["b", "a", "é", None]), date(2024, 1, 1 + rng.randrange(20)),
             Decimal(rng.randrange(100)) / 4, (rng.randrange(5), rng.choice("xy"))) for i in range(400)]
    df = spark.createDataFrame(rows, "k1 int, k2 string, k3 bigint, s string, d date, m decimal(10,2), t struct<a:int,b:string>").repartition(5)
    got = {}
    for r in Q.column_ranks(df, ["k1", "k2", "k3"], ["s", "d", "m", "t"]).collect():
        got.setdefault(r.series, {})[(r.k1, r.k2, r.k3)] = r["rank"]
    for at, name in ((3, "s"), (4, "d"), (5, "m"), (6, "t")):
        order = sorted((r for r in rows if r[at] is not None), key=lambda r: (r[at].encode() if name == "s" else r[at], r[:3]))
        assert [got[name][r[:3]] for r in order] == list(range(1, len(order) + 1))
    for key in ("k2", "d"):
        out = R.fixed_size_batches(df, [key, "k3"], 7).orderBy(key, "k3").collect()
        assert [(r.batch, r.index_in_batch) for r in out] == [(i // 7, i % 7 + 1) for i in range(400)]
    out = R.fixed_size_batches(df.select(F.struct("k2", "k3").alias("key")), "key", 7).orderBy("key").collect()
    assert [r.index_in_batch for r in out] == [i % 7 + 1 for i in range(400)]


def test_ranking_needs_no_more_exchanges_for_more_columns(spark):
    df, _ = skewed(spark)
    def exchanges(columns):
        return Q.rank_reorder(df, "id", columns, df)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(["a", "b", "c"]) == exchanges(["a"])


def test_empty_and_null_columns(spark):
    empty = spark.createDataFrame([], "id bigint, a double, b double")
    assert Q.column_ranks(empty, "id", ["a", "b"]).count() == 0
    assert R.fixed_size_batches(empty.select("id"), "id", 10).count() == 0
    nulls = spark.createDataFrame([(1, None, 2.0), (2, 5.0, 2.0)], "id bigint, a double, b double")
    assert [(r.id, r["rank"]) for r in Q.column_ranks(nulls, "id", ["a"]).collect()] == [(2, 1)]
    got = {r.id: (r.a, r.b) for r in Q.average_ranks(nulls, "id", ["a", "b"]).collect()}
    assert got == {1: (None, 1.5), 2: (1.0, 1.5)}


def test_group_quantiles(spark):
    df, pdf = skewed(spark)
    df = df.withColumn("g", F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string"))).withColumn("b", F.when(F.col("id") % 7 > 0, F.col("b")))
    pdf = df.toPandas()
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {(r.g, r.series): r for r in R.group_quantiles(df, ["g"], ["a", "b"], probs).collect()}
    assert set(got) == {(g, c) for g in "012" for c in "ab"}
    for (g, c), r in got.items():
        values = pdf[pdf.g == g][c].dropna()
        assert r.n == len(values) and list(r.q) == pytest.approx([values.quantile(p) for p in probs], abs=1e-12)
    one = R.group_quantiles(df, [], ["b"], [0.5]).first()
    assert one.q[0] == pytest.approx(pdf.b.median()) and R.group_quantiles(df.limit(0), ["g"], ["a"], [0.5]).count() == 0
    plan = R.group_quantiles(df, ["g"], ["a"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect" not in plan.lower()


def test_batches(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(25)], "id bigint")
    got = [(r.batch, r.index_in_batch) for r in R.fixed_size_batches(df, "id", 10).orderBy("id").collect()]
    assert got == [(i // 10, i % 10 + 1) for i in range(25)]


def test_spearman_and_pearson(spark):
    df, pdf = skewed(spark)
    want = pdf[["a", "b", "c"]].rank().corr()
    for r in Q.spearman_matrix(df, "id", ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-6)
    want = pdf[["a", "b", "c"]].corr()
    for r in Q.pearson_matrix(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-6)


def test_reorder_keeps_values_and_follows_scores(spark):
    df, pdf = skewed(spark, 600)
    scores = df.select("id", (F.col("b") * -1).alias("a"), F.col("id").cast("double").alias("b"))
    out = Q.rank_reorder(df.select("id", "a", "b"), "id", ["a", "b"], scores).toPandas().sort_values("id")
    assert sorted(out.a) == sorted(pdf.a) and sorted(out.b) == sorted(pdf.b)
    assert list(out.b) == sorted(pdf.b)
    by_score = out.merge(pdf[["id", "b"]].rename(columns={"b": "s"}), on="id").sort_values("s", ascending=False)
    assert by_score.a.is_monotonic_increasing


def test_quantiles_and_co_exceedance(spark):
    df, pdf = skewed(spark, 501)
    q = Q.exact_quantiles(df, ["a", "b", "c"], 0.9).first()
    for c in ("a", "b", "c"):
        assert q[c] == pytest.approx(np.quantile(pdf[c], 0.9))
    r = Q.co_exceedance(df, df, ["a", "b"]).first()
    both = ((pdf.a > np.quantile(pdf.a, .9)) & (pdf.b > np.quantile(pdf.b, .9))).mean()
    assert (r.before, r.after, r.change) == (pytest.approx(both, abs=1e-6), pytest.approx(both, abs=1e-6), 0.0)


def test_small_numeric_operators(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 5.0), (3, 3.0, 7.0)], "id int, x double, y double")
    assert tuple(Q.trend_line(df, "x", "y").first()) == (2.0, 1.0)
    mixed = Q.linear_mix(df, "id", ["x", "y"], [[1, 0], [0.5, 2]]).orderBy("id").collect()
    assert [(r.x, r.y) for r in mixed] == [(1.0, 6.5), (2.0, 11.0), (3.0, 15.5)]
    s = {r.series: r for r in Q.marginal_summary(df, ["x", "y"], 3).collect()}
    assert (s["x"]["mean"], s["x"]["std"], s["y"]["max"]) == (2.0, 0.816, 7.0)
    m = spark.createDataFrame([("a", "b", c) for c in (0.6, 0.5, 0.0, -0.5, -0.6)], "col_a string, col_b string, corr double")
    assert [r.band for r in Q.correlation_band(m).collect()] == ["strong", "mild", "independent", "mild opposite", "strong opposite"]
    a, b = m.limit(1), m.limit(1).withColumn("corr", F.lit(0.9))
    assert Q.matrix_gap(a, b).first()[0] == pytest.approx(0.3)


@pytest.fixture(scope="module")
def weighted(spark):
    rows = [(i, "A" if i % 3 else "B", "p", (i % 4) / 4 + 0.25, date(2024, 1 + i % 2, 1), f"text {i}") for i in range(40)]
    return spark.createDataFrame(rows, "review_id int, company string, product string, review_weight double, date date, review string")


def test_top_n_cuts_before_the_shuffle(weighted):
    out = R.topn_by_weight(weighted, 3)
    assert [r.review_id for r in out.filter("company = 'A'").orderBy("rank").collect()] == [7, 11, 19]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_top_n_beyond_the_optimizers_limit(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    got = R.top_n(df, ["g"], [F.desc("id")], 1500, "rank")
    assert got.groupBy("g").count().orderBy("g").collect() == [(0, 1500), (1, 1500)]
    assert got.filter("rank = 1500 and g = 0").first().id == 4998 - 2 * 1499


def test_balanced_sides(weighted):
    got = R.balanced_topn(weighted, "A", "B", 80, threshold=0.75).groupBy("company").count().collect()
    assert {r.company: r["count"] for r in got} == {"A": 7, "B": 7} or len({r["count"] for r in got}) == 1
    assert R.balanced_topn(weighted, "A", "B", 2, threshold=0.1).count() == 4
    assert R.balanced_topn(weighted, "A", "nobody", 2).count() == 0


def test_recent_n_gives_the_odd_one_to_the_primary(weighted):
    got = R.recent_n(weighted.withColumn("year", F.year("date")), "A", 5).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in got} == {"primary": 3, "market": 2}


def test_month_sample_fills_its_quotas(weighted):
    df = weighted.withColumn("month", F.col("date"))
    out = R.proportional_month_sample(df, 10)
    assert out.count() == sum(r.quota for r in out.select("month", "quota").distinct().collect()) == 10
    again = R.proportional_month_sample(df.repartition(5), 10)
    assert out.select("review_id").exceptAll(again.select("review_id")).count() == 0
    rare = df.withColumn("month", F.col("review_id"))
    assert R.proportional_month_sample(rare, 10).count() == 0  # every share is below one review


def test_evidence_text(weighted):
    ranked = R.topn_by_weight(weighted, 2)
    got = {r.company: r.evidence for r in R.numbered_evidence_text(ranked, ["company"], label=F.col("company")).collect()}
    assert got["A"] == "Review 1 (A): text 7\nReview 2 (A): text 11"
    context = R.side_by_side_context(ranked, "A", "B").first().context
    assert context == "A Reviews (2):\ntext 7 text 11\n\nB Reviews (2):\ntext 3 text 15"


def test_reordering_sorts_once_and_moves_no_keys_with_the_values(spark):
    rows = [(i % 7, i, float(i % 3), None if i % 5 == 0 else float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, l int, a double, b double")
    scores = df.select("k", "l", (F.col("l") * 37 % 101).alias("a"), F.when(F.col("b").isNotNull(), F.col("l") * 53 % 97).alias("b"))
    out = Q.rank_reorder(df, ["k", "l"], ["a", "b"], scores)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan" in line and "_at#" in line]
    assert scans and not any("ExistingRDD" in line for line in scans)  # a checkpoint: its rows were sorted twice
    assert not any("_value#" in line and "k#" in line for line in scans)
    got = {(r.k, r.l): (r.a, r.b) for r in out.collect()}
    table = {(r[0], r[1]): r for r in rows}
    for at, name in ((2, "a"), (3, "b")):
        score = {(r.k, r.l): r[name] for r in scores.collect() if r[name] is not None}
        order = sorted(score, key=lambda key: (score[key], *key))
        assert [got[key][at - 2] for key in order] == sorted(table[key][at] for key in table if table[key][at] is not None)


def test_stored_tables_leave_no_shuffle_files(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(FREE_SHUFFLES, None)
    kept = store(spark.range(10000).repartition(5, "id").groupBy((F.col("id") % 1000).alias("g")).agg(F.sum("id").alias("s")), "test")
    until = time.time() + 20  # they are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 1000 and spark.conf.get(FREE_SHUFFLES, None) == setting


def test_reordering_moves_no_keys_that_are_not_asked_for(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), rng.choice(["x", "y", None]), rng.choice([None, float("nan"), *map(float, range(40))]),
             float(rng.randrange(500)), rng.choice([None, *range(9)]), rng.randrange(100)) for _ in range(300)]
    df = spark.createDataFrame(rows, "key1 int, key2 string, a double, b double, sa int, sb int").repartition(4)
    scores = df.select("key1", "key2", F.col("sa").alias("a"), F.when(F.col("key1") > 2, F.col("sb")).alias("b"))
    out = Q.rank_reorder(df, ["key1", "key2"], ["a", "b"], scores)
    plan = out.select("a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "a#" in plan and "key1" not in plan and "key2" not in plan

    nulls_first = lambda values: tuple((v is not None, v) if v is not None else (False, 0 if i != 1 else "") for i, v in enumerate(values))
    nan_last = lambda v: (v != v, 0 if v != v else v)
    want = {}
    for at, score in ((2, lambda r: r[4]), (3, lambda r: r[5] if (r[0] or 0) > 2 else None)):
        ranked = sorted((r for r in rows if score(r) is not None), key=lambda r: (score(r), nulls_first(r[:2])))
        for r, v in zip(ranked, sorted((r[at] for r in rows if r[at] is not None), key=nan_last)):
            cell = want.setdefault(r[:2], [None, None])
            cell[at - 2] = v if cell[at - 2] is None else max(cell[at - 2], v, key=nan_last)
    got = {(r.key1, r.key2): [r.a, r.b] for r in out.collect()}
    assert out.count() == len(got) and {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
