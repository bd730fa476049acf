"""Filters and hygiene on handmade rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from voicegrid import schema
from voicegrid.operators import clean as C


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, "a" * 14, "01/01/2024", "A"), (2, "a" * 15, "31/02/2024", "A"), (3, None, "2/1/2024", None),
        (4, "", "03/01/2024", "B"), (5, "   ", None, "B"), (6, "a" * 15, "04/01/2024", "B"), (7, "b" * 20, "05/01/24", "C"),
    ], "id int, review string, date_text string, company string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filters(rows):
    assert ids(C.drop_null_essential(rows, ["review", "company"])) == [1, 2, 4, 5, 6, 7]
    assert ids(C.drop_blank_text(rows, "review")) == [1, 2, 6, 7]
    assert ids(C.min_length_filter(rows, "review")) == [2, 6, 7]
    assert ids(C.drop_invalid_dates(rows, "date_text")) == [1, 3, 4, 6, 7]
    assert ids(C.head_sample(rows, "id", 2)) == [1, 2]
    assert ids(C.exclude_unknown(rows, "company", "B")) == [1, 2, 3, 7]
    assert ids(C.mention_filter(rows, "review", ["BBB"])) == [7]
    assert ids(C.regex_contains_filter(rows, "company", "^[AB]$")) == [1, 2, 4, 5, 6]
    assert ids(C.regex_contains_filter(rows, "company", "A.", literal=True)) == []
    assert ids(C.regex_contains_filter(rows, "company", None)) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(C.regex_contains_filter(rows, "company", "Wallbox")) == []


def test_dedup_keeps_first_and_is_idempotent(rows):
    once = C.dedup_exact_keep_first(rows, "review", "id")
    assert ids(once) == [1, 2, 3, 4, 5, 7]
    assert ids(C.dedup_exact_keep_first(once, "review", "id")) == ids(once)
    assert ids(C.dedup_exact_keep_first(rows.repartition(7), "review", "id")) == ids(once)


def test_dedup_of_a_hot_text_moves_one_row_per_task(spark):
    hot = spark.range(10000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(
        F.col("id").cast("string")).alias("review"))
    assert C.dedup_exact_keep_first(hot, "review", "id").count() == 6667
    tied = spark.createDataFrame([(1, 2, "x"), (1, 1, "x"), (0, 3, "y"), (1, 1, "y")], "d int, id int, review string")
    assert sorted(map(tuple, C.dedup_exact_keep_first(tied, "review", "d", "id").collect())) == [(0, 3, "y"), (1, 1, "x")]


def test_canonical_spelling_is_the_first_seen(spark):
    from voicegrid.operators.annotate import canonical_spelling, label_lookup
    from voicegrid import dims
    df = spark.createDataFrame([(3, "ACME "), (1, "Acme"), (2, "acme"), (4, None), (5, "Other")], "id int, company string")
    got = {r.id: r.company for r in canonical_spelling(df, "company", "id").collect()}
    assert got == {1: "Acme", 2: "Acme", 3: "Acme", 4: None, 5: "Other"}
    shown = label_lookup(df, "company", dims.label_dim(spark, {"Other": "* Other"}), "label")
    assert {r.id: r.label for r in shown.collect()} == {1: "Acme", 2: "acme", 3: "ACME ", 4: None, 5: "* Other"}


def test_large_lookups_are_not_broadcast(spark):
    from voicegrid.session import broadcast_if_small
    dim = spark.range(50).toDF("k")
    plan = lambda rows: spark.range(9).toDF("k").join(broadcast_if_small(dim, rows), "k")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(50).lower() and "broadcast" not in plan(49).lower()


def test_quality_report_adds_up(rows):
    r = C.data_quality_report(rows, "date_text", "review").first()
    assert (r.loaded, r.invalid_date, r.too_short, r.kept) == (7, 2, 3, 2)
    assert r.loaded == r.invalid_date + r.too_short + r.kept
    empty = C.data_quality_report(rows.limit(0), "date_text", "review").first()
    assert (empty.loaded, empty.quality_pct) == (0, 0.0)


def test_majority_date_format(spark):
    month_first = spark.createDataFrame([("12/25/2024",), ("01/31/2024",), ("02/03/2024",)], ["d"])
    assert [r.p for r in C.parse_date_majority(month_first, "d", "p").collect()] == [
        date(2024, 12, 25), date(2024, 1, 31), date(2024, 2, 3)]
    day_first = spark.createDataFrame([("25/12/2024",), ("02/03/2024",)], ["d"])
    assert [r.p for r in C.parse_date_majority(day_first, "d", "p").collect()] == [date(2024, 12, 25), date(2024, 3, 2)]


def test_contract(rows):
    assert schema.missing_columns(rows, ["id", "rating"]) == ["rating"]
    with pytest.raises(ValueError, match="rating, title"):
        schema.contract_check(rows, ["rating", "title", "id"])


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, date(2023, 5, 1)), (2, date(2024, 5, 1))], "id int, d date").write.parquet(path)
    df = C.year_filter(spark.read.parquet(path), "d", 2024)
    assert ids(df) == [2]
    assert "GreaterThanOrEqual(d,2024-01-01)" in df._jdf.queryExecution().executedPlan().toString()
    assert ids(C.year_filter(spark.read.parquet(path), "d", None)) == [1, 2]
