"""Derived columns on handmade rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from voicegrid import dims
from voicegrid.functions import dates as D, labels as L, scores as S, words as W
from voicegrid.operators import annotate as A, clean as C


def values(spark, column, inputs, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_lenient_dates(spark):
    got = values(spark, D.parse_lenient, ["31/02/2024", "1/2/2024", "25/07/24", "2024-07-25", None, "25/12/2023"])
    assert got == [None, date(2024, 2, 1), date(2024, 7, 25), date(2024, 7, 25), None, date(2023, 12, 25)]


def test_strict_dates_fail(spark):
    with pytest.raises(Exception, match="31/02/2024|CANNOT_PARSE|PARSE"):
        values(spark, D.parse_strict, ["31/02/2024"])


def test_weeks_end_on_monday(spark):
    days = [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 7), date(2024, 1, 8)]  # Mon Tue Sun Mon
    assert values(spark, D.week_ending_monday, days, "date") == [
        date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 8), date(2024, 1, 8)]


def test_rounding_is_half_even(spark):
    assert values(spark, lambda c: S.half_even(c), [0.5, 1.5, 2.5, -2.5, 6.5249999999999996], "double") == [0, 2, 2, -2, 7]
    assert values(spark, lambda c: S.half_even(c, 2), [2.675, 1.005, 0.125], "double") == [2.68, 1.0, 0.12]
    assert values(spark, S.rescale_100_int, [0.005, 0.015, -0.025], "double") == [0, 2, -2]


def test_word_shape(spark):
    n = lambda k: "word " * k
    texts = [None, "", n(49), n(50), n(149), n(150), n(151)]
    words = lambda c: F.size(W.chunks(c))
    assert values(spark, words, texts) == [0, 0, 49, 50, 149, 150, 151]
    assert values(spark, lambda c: S.length_bucket(words(c)), texts) == [
        "Short", "Short", "Short", "Medium", "Medium", "Long", "Long"]
    assert values(spark, lambda c: S.length_score(words(c)), texts) == [0, 0, .327, .333, .993, 1, 1]


def test_payment_method(spark):
    texts = ["I pay by DD", "add it up", "pre-paid meter", "top-up card", "pay as you go", "PREPAYMENT", "cash", None,
             "direct debit and key"]
    assert values(spark, L.payment_method, texts) == [
        "Direct Debit", "Other/Unspecified", "Prepayment Meter", "Prepayment Meter", "Prepayment Meter",
        "Prepayment Meter", "Other/Unspecified", "Other/Unspecified", "Direct Debit"]


def test_fuel_type(spark):
    texts = ["British Gas is slow", "gas and power", "boiler kwh plug", "british gas boiler", None, "power cut", "gases"]
    assert values(spark, L.fuel_type, texts) == [
        "Unknown", "Unknown", "Electricity", "Gas Supply", "Unknown", "Electricity", "Unknown"]


def test_phrase_counts_each_word_and_phrase(spark):
    assert values(spark, lambda c: W.count_each(c, dims.POWER_TERMS), ["power cut", "a Power outage, power"]) == [2, 3]


def test_tariff_switching_flags(spark):
    assert values(spark, L.tariff_type, ["fixed deal, variable", "a tracker", "fixedly", None]) == [
        "Fixed", "Variable", "Unknown", "Unknown"]
    assert values(spark, L.switching_stage, ["I will switch, switched to X", "moved to Y", "stay", None]) == [
        "Intent", "Outcome", "None", "None"]
    assert values(spark, L.smart_meter_flag, ["Smart meter!", "smart meters", "meter", None]) == [1, 1, 0, 0]
    assert values(spark, L.regulatory_flag, ["the T&C say", "my contractor", "tandc", None]) == [1, 1, 0, 0]
    assert values(spark, L.promo_flag, ["Exit fee", "exitfee"]) == [1, 0]


def test_word_edges_are_unicode(spark):
    assert values(spark, lambda c: W.has_word(c, ["as"]), ["éas", "as-is", "éas as", "AS", "was", None]) == [
        False, True, True, True, False, False]
    assert values(spark, lambda c: W.has_word(c, ["as", "due to"]), ["éas", "due to x", "overdue to"]) == [
        False, True, False]


def test_word_paths_agree(spark):
    """Counting by word list and by pattern give the same result for single words."""
    texts = ["Bill bill, billing; BILL", "éas as as-is as_is", "", None, "a b a"]
    terms = ["bill", "as", "a"]
    by_list = values(spark, lambda c: W.count_words(c, terms), texts)
    by_pattern = values(spark, lambda c: F.coalesce(F.regexp_count(F.lower(c), F.lit(W.word_pattern(terms))), F.lit(0)), texts)
    assert by_list == by_pattern == [3, 2, 0, 0, 2]


def test_phrase_prefilter_changes_nothing(spark):
    """Counts and flags equal those of one plain pattern over whole documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    for terms in (["of the", "of", "the"], ["as", "is that", "a-b"], ["in in", "in"]):
        pattern, low = W.word_pattern(terms), F.lower("text")
        odd = docs.filter((W.count_words(F.col("text"), terms) != F.regexp_count(low, F.lit(pattern)))
                          | (W.has_word(F.col("text"), terms) != low.rlike(pattern)))
        assert odd.count() == 0
    assert docs.filter(W.has_word(F.col("text"), ["of the"])).count() > 0


def test_topic_counts_with_phrases(spark):
    df = spark.createDataFrame([(1, "Smart meter reading and a meter"), (2, None)], "id int, review string")
    got = {r.id: r for r in A.topic_keyword_counts(df, "review").collect()}
    # The alternation lists "meter" before "smart meter"; the leftmost match is the phrase.
    assert got[1].kw_technical_meter == 3
    assert got[2].kw_technical_meter == 0
    assert got[1].kw_green == 0


def test_first_category(spark):
    assert values(spark, L.first_category, ["my boiler bill", "Leaking pipe", "a bill", "nothing", None]) == [
        "Boiler Services", "Plumbing & Drains", "Energy", "other", "other"]


def test_spam_threshold_before_and_after_rounding(spark):
    df = spark.createDataFrame([(0.9,), (0.9004,), (0.9006,)], "c double")
    rows = df.select(S.spam_decision(F.lit("spam"), F.col("c")), S.spam_decision(F.lit("spam"), F.col("c"), 3)).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, False), (True, True)]


def test_review_weight_values(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, True, False), (False, False, True),
                                (False, False, False)], "spam boolean, just boolean, en boolean")
    got = [r[0] for r in df.select(S.review_weight(F.col("spam"), F.col("just"), F.col("en"))).collect()]
    assert got == [0.0, 1.0, 0.5, 0.9, 0.45]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.row_mean([F.col("a"), F.col("b")])).collect()] == [1.0, None, 1.5]


def test_topic_coverage_without_mentions(spark):
    df = spark.createDataFrame([(0, 0), (0, None)], "a int, b int")
    assert [r.topic_cov_n for r in A.topic_coverage(df, ["a", "b"]).collect()] == [0.0, 0.0]


def test_annotate_is_native(spark):
    df = spark.createDataFrame([("My smart meter bill, because of the app", date(2024, 5, 17))], "review string, date date")
    out = A.annotate(df)
    plan = out.drop("topic_cov_n", "quality_score")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan  # coverage alone needs a number of the whole table
    row = out.first()
    assert (row.topic_cov_n, row.category, row.review_weight, row.quality_score) == (1.0, "Energy", 1.0, 0.411)
    assert (row.month, row.smart_meter_flag, row.justification, row.channel_app, row.kw_billing_pricing) == (
        date(2024, 5, 1), 1, 1, 1, 1)


def test_unread_annotations_cost_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("date", F.lit(date(2024, 1, 1)))
    plan = A.annotate(docs, "text").groupBy("month").count()._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]


def test_header_names(spark):
    df = spark.createDataFrame([("a", "b", "c")], ["Date ", " Final Product Category", "Other"])
    assert C.normalize_headers(df).columns == ["date", "product", "Other"]
