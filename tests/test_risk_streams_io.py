"""Weekly series, risk indicators, streams, sources and sinks."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import risk as K
from voicegrid.sources import reviews as R, sinks as S
from voicegrid.streaming import jobs as J


def test_weeks_are_complete(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1, 0.5), (date(2024, 1, 2), 1, 0.25), (date(2024, 1, 16), 0, 1.0)],
                               "date date, f int, s double")
    assert [tuple(r) for r in K.weekly_flag_sum(df, "f").orderBy("week").collect()] == [
        (date(2024, 1, 1), 1), (date(2024, 1, 8), 1), (date(2024, 1, 15), 0), (date(2024, 1, 22), 0)]
    assert [r["mean"] for r in K.weekly_mean(df, "s").orderBy("week").collect()] == [0.5, 0.25, None, 1.0]
    assert K.weekly_flag_sum(df.limit(0), "f").count() == 0
    assert [r.week.day for r in K.last_k_weeks(K.weekly_flag_sum(df, "f"), 2).collect()] == [15, 22]


@pytest.fixture(scope="module")
def mentions(spark):
    last = date(2024, 6, 30)
    rows = [(last, "Ofgem contract", 0.2), (last - timedelta(6), "terms", 0.4), (last - timedelta(7), "CONTRACT", 0.9),
            (last - timedelta(96), "ofgem", 0.7), (last - timedelta(97), "ofgem", 0.1), (last, "nothing", 0.0)]
    return spark.createDataFrame(rows, "date date, review string, sentiment double")


def test_recent_against_baseline(mentions):
    r = K.recent_vs_baseline(mentions, "review", {"ofgem": 1, "contract": 1, "terms": 0.5}).first()
    assert (r.recent_count, r.base_count, r.base_avg) == (2.5, 2.0, 0.2)
    assert r.rate_ratio == pytest.approx(2.5 / (2 * 7 / 90))
    assert (r.recent_sentiment, r.base_sentiment, r.verdict) == (pytest.approx(0.3), pytest.approx(0.8), "bad")
    none = K.recent_vs_baseline(mentions, "review", {"absent": 1}).first()
    assert (none.recent_count, none.rate_ratio) == (0.0, None)


def test_drivers(mentions):
    got = K.risk_drivers(mentions, "review", ["ofgem", "contract", "terms", "absent"]).collect()
    assert [(r.keyword, r.recent_count) for r in got] == [("contract", 1), ("ofgem", 1), ("terms", 1)]
    assert got[0].sent_diff == pytest.approx(-0.7) and got[0].level == "spike" and got[2].ratio is None


def test_several_risk_maps_in_one_scan(mentions):
    maps = {"reg": {"ofgem": 1, "contract": 1, "terms": 0.5}, "other": {"OFGEM": 2, "absent": 1}, "none": {"absent": 1}}
    out = K.risk_overview(mentions, "review", maps)
    got = {r.risk: r for r in out.collect()}
    assert set(got) == set(maps)
    for name, words in maps.items():
        want = K.recent_vs_baseline(mentions, "review", words).first().asDict()
        assert {k: v for k, v in got[name].asDict().items() if k in want} == want
        drivers = K.risk_drivers(mentions, "review", list(words)).collect()
        assert [tuple(d) for d in got[name].drivers or []] == [tuple(d[c] for c in ("keyword", "recent_count", "ratio", "sent_diff", "level")) for d in drivers]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1


def event(i, day, kind="a", hour=0):
    return (i, datetime(2024, 1, 1) + timedelta(days=day, hours=hour), kind)


EVENTS = "event_id bigint, ts timestamp, event_type string"


def run_weekly(spark, base):
    events = J.file_stream(spark, f"{base}/in", spark.createDataFrame([], EVENTS).schema, files_per_trigger=1)
    J.start_weekly_mentions(events, f"{base}/out", f"{base}/cp").awaitTermination()
    return {(r.week, r.event_type): r.mentions for r in J.latest_counts(spark, f"{base}/out", ["week", "event_type"]).collect()}


def test_stream_counts_restart_and_late_rows(spark, tmp_path):
    flat = str(tmp_path)
    first_rows = [event(1, 0), event(2, 1), event(3, 2), event(4, 1, "b")]
    spark.createDataFrame(first_rows, EVENTS).coalesce(1).write.parquet(f"{flat}/in")
    first = run_weekly(spark, flat)
    assert first == {(date(2024, 1, 1), "a"): 1, (date(2024, 1, 8), "a"): 2, (date(2024, 1, 8), "b"): 1}
    assert run_weekly(spark, flat) == first  # nothing new after a restart
    spark.createDataFrame([event(5, 40)], EVENTS).coalesce(1).write.mode("append").parquet(f"{flat}/in")
    run_weekly(spark, flat)
    spark.createDataFrame([event(6, 1), event(7, 41)], EVENTS).coalesce(1).write.mode("append").parquet(f"{flat}/in")
    last = run_weekly(spark, flat)
    assert last[(date(2024, 1, 8), "a")] == 2  # the late row is dropped
    assert last[(date(2024, 2, 12), "a")] == 2


def test_stream_weeks_equal_batch_weeks(spark, tmp_path):
    df = spark.createDataFrame([event(i, i % 29, "ab"[i % 2], i % 24) for i in range(200)], EVENTS)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run_weekly(spark, str(tmp_path))
    from voicegrid.functions.dates import week_ending_monday
    want = df.groupBy(week_ending_monday(F.to_date("ts")).alias("w"), "event_type").count().collect()
    assert got == {(r.w, r.event_type): r["count"] for r in want}


def test_annotate_stream_resumes(spark, tmp_path):
    schema = "id int, review string"
    spark.createDataFrame([(1, "a")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: J.start_annotate_append(
        J.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema),
        lambda d: d.withColumn("n", F.length("review")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    run()
    spark.createDataFrame([(2, "bb")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a", 1), (2, "bb", 2)]


@pytest.mark.parametrize("files", [0, 1, 3])
def test_streams_read_a_table_of_one_file_or_a_folder(spark, tmp_path, files):
    from voicegrid.plans.streams import streaming_annotate_append, streaming_weekly_mentions
    docs = spark.createDataFrame([(i, "a bill" if i % 2 else None, "en") for i in range(6)], "doc_id bigint, text string, lang string")
    days = spark.createDataFrame([event(i, i % 29) for i in range(60)], EVENTS)
    for df, name in ((docs, "documents"), (days, "events"), (docs, "documents.parquet.old")):
        df.repartition(max(1, files)).write.parquet(f"{tmp_path}/{name}.parquet")
        if not files:  # one file instead of a folder
            part, = (tmp_path / f"{name}.parquet").glob("part-*")
            (tmp_path / name).mkdir()
            part.rename(tmp_path / name / f"{name}.parquet")
    def folder(name):
        return str(tmp_path if files else tmp_path / name)
    got = streaming_annotate_append(spark, folder("documents")).select("review_id", "chars").collect()
    assert sorted(tuple(r) for r in got) == [(i, 6 if i % 2 else None) for i in range(6)]
    assert streaming_weekly_mentions(spark, folder("events")).agg(F.sum("mentions")).first()[0] == 60


def test_csv_with_quotes_lines_and_bom(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('﻿Date,Rating,Title,Review,Company\n01/02/2024,5,"T, ""x""","line one\nline ""two"", end",Acme\n'
                    "02/02/2024,1,,,Corgi\n", encoding="utf-8")
    rows = R.scan_reviews_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("01/02/2024", 5, 'T, "x"', 'line one\nline "two", end', "Acme"),
                                        ("02/02/2024", 1, None, None, "Corgi")]


def test_report_format(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 3, 1), 0.125, 7, None)], "month date, score double, n int, gap double")
    S.write_report_csv(df, str(tmp_path / "out"), ["n", "month", "score", "gap", "absent"], 2)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("7", "2024-03", "0.12", None)]


def test_company_folders_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "Services A")], "id int, company string")
    S.write_per_company(df, str(tmp_path / "c"))
    one = R.company_partition_read(spark, str(tmp_path / "c"), "A")
    assert [r.id for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(company" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in R.company_partition_read(spark, str(tmp_path / "c"), "A", "Services").collect()] == [3]


def test_append_resume_and_log(spark, tmp_path):
    path, log = str(tmp_path / "done"), str(tmp_path / "log")
    df = spark.range(10).withColumnRenamed("id", "review_id")
    S.append_results(df.filter("review_id < 4"), path)
    rest = S.resume_unprocessed(df, spark.read.parquet(path), "review_id")
    assert rest.count() == 6
    S.append_results(rest, path)
    assert S.resume_unprocessed(df, spark.read.parquet(path), "review_id").count() == 0
    for n in (4, 6):
        S.run_log_append(spark, log, "in", "out", 10, n, ["a", "b"], "m", 0.1, 500, 1.5)
    assert sorted(r.rows_processed for r in spark.read.parquet(log).collect()) == [4, 6]


def test_work_dir_follows_the_session():
    from types import SimpleNamespace
    from voicegrid.session import work_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": folder}.get(key)),
                               sparkContext=SimpleNamespace(master=master))
    assert work_dir(session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert "voicegrid-" in work_dir(session("local[2]", None), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session("yarn", None), "x")
