"""Prompts, the model hook, reply parsers and validators."""

import time

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import enrich as E

VALID = ["Gas Products", "Energy", "Unknown"]


def single(spark, reply, **kw):
    df = spark.createDataFrame([(1, reply)], "id int, reply string")
    r = E.validate_classification(E.parse_single_reply(df), VALID, reply="reply", **kw).first()
    return r.score, r.category, r.reason


@pytest.mark.parametrize("reply,want", [
    ("Score: 85\nProduct: Energy\nReason: ok", (85, "Energy", "ok")),
    ("Score:85\nProduct:  Energy \nReason: ok\nmore", (85, "Energy", "ok")),
    ("Score: 120\nProduct: Energy\nReason: x", (0, "Unknown", E.INVALID + E.BAD_CONFIDENCE)),
    ("Score: 60\nProduct: Energy supply\nReason: x", (60, "Energy", "x")),
    ("Score: 60\nProduct: Cars\nReason: x", (0, "Unknown", "Invalid AI Response: Category 'Cars' is not a valid option.")),
    ("Score: 60\nProduct: Energy", (0, "Unknown", E.UNPARSED)),
    ("Score: 99999999999\nProduct: Energy\nReason: x", (0, "Unknown", E.INVALID + E.BAD_CONFIDENCE)),
    ("", (0, "Unknown", E.CALL_FAILED)), (None, (0, "Unknown", E.CALL_FAILED)),
])
def test_single_reply(spark, reply, want):
    assert single(spark, reply) == want


def test_product_line_may_be_optional(spark):
    df = spark.createDataFrame([(1, "Score: 5\nReason: r")], "id int, reply string")
    r = E.parse_single_reply(df, product_optional=True).first()
    assert (r.raw_score, r.raw_product, r.raw_reason) == ("5", E.NO_PRODUCT, "r")


def test_strict_mode_does_not_salvage(spark):
    assert single(spark, "Score: 60\nProduct: Energy supply\nReason: x", salvage=False)[:2] == (0, "Unknown")


def test_batch_reply(spark):
    reply = ("intro [Review 2]\nScore: 1\nProduct: Energy\nReason: two [Review x]\n[Review 9]\nScore: 5\nProduct: Energy\n"
             "Reason: far\n[Review 1]\nScore: 3\n[Review 2]\nScore: 2\nProduct: Unknown\nReason: again")
    df = spark.createDataFrame([(7, 3, reply), (8, 2, "nothing")], "batch int, size int, reply string")
    got = [tuple(r) for r in E.parse_batch_reply(df, ["batch"]).collect()]
    assert got == [(7, 2, "2", "Unknown", "again")]


def test_aspect_blocks(spark):
    reply = ("Aspect: A\nScore: -30\nReason: slow\n\nAspect: B\nscore: n/a\nReason: none\nAspect: C\nScore: 1\n"
             "Aspect: Z\nScore: 1\nReason: not asked\nAspect: D\nScore: 101\nReason: high")
    df = spark.createDataFrame([(1, reply)], "id int, reply string")
    got = {r.aspect: (r.score, r.reason) for r in E.validate_sentiment(
        E.parse_aspect_blocks(df, ["id"], ["A", "B", "C", "D"])).collect()}
    assert got == {"A": (-30, "slow"), "B": (0, "Aspect 'B' was not mentioned in the review."),
                   "D": (0, E.INVALID + E.BAD_SENTIMENT)}


def test_missing_replies_get_defaults(spark):
    grid = spark.createDataFrame([(1, i) for i in (1, 2)], "batch int, i int")
    have = spark.createDataFrame([(1, 2, 9, None)], "batch int, i int, score int, reason string")
    out = E.fill_missing_replies(grid, have, ["batch", "i"], {"score": 0, "reason": E.MISSING_REPLY}).orderBy("i").collect()
    assert [(r.score, r.reason) for r in out] == [(0, E.MISSING_REPLY), (9, None)]


def test_issue_json(spark):
    df = spark.createDataFrame([(1, '{"issues": [{"summary": "a"}, {"action": "b", "bg_quote": "q"}]}'),
                                (2, '{"issues": []}'), (3, "{bad"), (4, None), (5, "{}")], "id int, reply string")
    got = [tuple(r) for r in E.explode_issue_json(df, ["id"]).orderBy("id", "issue_no").collect()]
    assert got == [(1, 1, "a", "", "", "", ""), (1, 2, "", "q", "", "", "b")]


def test_model_hook_retries_and_never_fails_the_job(spark):
    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return prompt.upper()
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")
    for retries in (0, 2):
        got = {r.id: (r.reply, r.error) for r in E.batch_infer(df, "id", "prompt", model, retries=retries).collect()}
        assert got == {1: ("OK", None), 2: (None, "RuntimeError - down")}
    single = E.validate_classification(E.parse_single_reply(E.batch_infer(df, "id", "prompt", model)), VALID, reply="reply")
    assert {r.id: r.reason for r in single.collect()} == {1: E.UNPARSED, 2: E.CALL_FAILED}


@pytest.mark.parametrize("callers", [1, 4, 8])
def test_the_rate_is_that_of_the_job(spark, callers):
    df = spark.range(24).select("id", F.col("id").cast("string").alias("prompt"))
    calls = E.batch_infer(df, "id", "prompt", lambda p: str(time.time()), calls_per_second=12, callers=callers)
    times = sorted(float(r.reply) for r in calls.collect())
    assert len(times) == 24 and calls.rdd.getNumPartitions() == callers
    # In any second there are at most the allowed calls, and one first call of each task.
    assert max(sum(t <= x < t + 1 for x in times) for t in times) <= 12 + callers


def test_replies_are_asked_for_once(spark, tmp_path):
    path, log = str(tmp_path / "replies"), tmp_path / "log"
    log.mkdir()

    def model(prompt, folder=str(log)):
        with open(f"{folder}/{prompt}", "a") as f:
            f.write("x")
        if prompt == "3" and len(open(f"{folder}/{prompt}").read()) < 3:
            raise RuntimeError("down")
        return f"reply {prompt}"

    def asked():
        return {f.name: len(f.read_text()) for f in log.iterdir()}

    df = spark.range(20).select("id", F.col("id").cast("string").alias("prompt"))
    first = E.stored_replies(df.filter("id < 12"), "id", "prompt", model, path, retries=1)
    assert first.count() == 12 and asked() == {str(i): 1 for i in range(12)}
    both = E.stored_replies(df, "id", "prompt", model, path, rounds=3, retries=1)
    got = {r.id: (r.reply, r.error) for r in both.collect()}
    assert got == {i: (f"reply {i}", None) if i != 3 else (None, "RuntimeError - down") for i in range(20)}
    assert asked() == {str(i): 1 for i in range(20)}
    again = E.stored_replies(df, "id", "prompt", model, path, again=True, retries=2)
    assert {r.id: r.reply for r in again.collect()} == {i: f"reply {i}" for i in range(20)}
    assert asked() == {str(i): 3 if i == 3 else 1 for i in range(20)}


def test_failed_batches_say_so(spark):
    grid = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, "busy")], "batch int, i int, error string")
    have = spark.createDataFrame([(1, 1, 9, "r")], "batch int, i int, score int, reason string")
    out = E.fill_missing_replies(grid, have, ["batch", "i"], {"score": 0, "reason": E.MISSING_REPLY}, error="error")
    assert [(r.score, r.reason) for r in out.orderBy("batch", "i").collect()] == [
        (9, "r"), (0, E.MISSING_REPLY), (0, E.CALL_FAILED)]


def test_batch_aspect_reply(spark):
    reply = ("[Review 1]\nAspect: A\nScore: 5\nReason: one\nAspect: B\nScore: N/A\nReason: no\n"
             "[Review 2]\nAspect: A\nScore: -7\nReason: two\n[Review 3]\nAspect: A\nScore: 1\nReason: far\n"
             "[Review 1]\nAspect: A\nScore: 6\nReason: later")
    df = spark.createDataFrame([(4, 2, reply), (5, 2, None), (6, 2, "")], "batch int, size int, reply string")
    got = {tuple(r) for r in E.parse_batch_aspect_reply(df, ["batch"], ["A", "B"]).collect()}
    assert got == {(4, 1, "A", "6", "later"), (4, 2, "A", "-7", "two")}


def test_prompts(spark):
    dim = spark.createDataFrame([(1, "B"), (0, "A")], "ord int, name string")
    block = E.bullet_block(dim, F.concat(F.lit("- "), "name"), "ord", "aspects")
    df = spark.createDataFrame([("late", None)], "review string, company string")
    out = E.prompt_column(df, "For {company}:\n{aspects}\n\"{review}\" {review}",
                          {"company": "company", "aspects": "aspects", "review": "review"}, block)
    assert out.first().prompt == 'For :\n- A\n- B\n"late" late'
    batched = spark.createDataFrame([(0, 2, "y"), (0, 1, "x")], "batch int, index_in_batch int, review string")
    assert E.batch_prompts(batched).first().prompt == '[Review 1]: "x"\n[Review 2]: "y"'


def test_blank_reviews_pass_through(spark):
    df = spark.createDataFrame([(1, "text"), (2, " \n "), (3, None)], "id int, review string")
    seen = lambda d: d.withColumns({"score": F.lit(5), "reason": F.lit("r")})
    got = {r.id: (r.score, r.reason) for r in E.blank_review_passthrough(df, "review", seen, ["score"], ["reason"]).collect()}
    assert got == {1: (5, "r"), 2: (None, E.NO_REVIEW), 3: (None, E.NO_REVIEW)}


def test_pivot_and_insights(spark):
    long = spark.createDataFrame([(1, "Customer Service", 5, "r")], "id int, aspect string, score int, reason string")
    r = E.pivot_aspect_results(long, ["id"], ["Customer Service", "Net Zero"]).first()
    assert (r.Customer_Service_Score, r.Customer_Service_Reasoning, r.Net_Zero_Score) == (5, "r", None)
    df = spark.createDataFrame([("C", "p", "a", 1.25, None, 2024, " t ")],
                               "competitor string, product string, aspect string, s double, d double, year int, x string")
    assert tuple(E.insight_rows(df, "s", "d", "x").first()) == ("C", "p", "a", "1.2", "N/A", 2024, "t")
