"""Queries over model enrichment. Replies are derived from every review, so all branches of the
parsers and validators occur; the model itself is a deterministic stand-in."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voicegrid.operators import compare as M, enrich as E, rank as R, rollups as U
from voicegrid.plans import comparisons as CP, views as V
from voicegrid.plans.registry import query
from voicegrid.plans.rollups import ASPECTS
from voicegrid.session import work_dir
from voicegrid.sources.sinks import append_results

VALID = ["Energy", "Gas Products", "Unknown"]
BATCH = 10
REPLIES = ["Score: 85\nProduct: Energy\nReason: ok", "Score: 70\nProduct: Gas Products\nReason:  fine ",
           "Score: 85\nProduct: Energy", "Score: 120\nProduct: Energy\nReason: big",
           "Score: 60\nProduct: Energy supply\nReason: extra", "Score: 40\nProduct: Cars\nReason: odd", ""]
ASPECT_REPLIES = ["Aspect: speed\nScore: 40\nReason: quick\nAspect: value\nScore: -101\nReason: dear",
                  "Aspect: speed\nScore: N/A\nReason: none\n\nAspect: value\nScore: -30\nReason: so so\n",
                  "Aspect: speed\nScore: 10\nAspect: support\nScore: na\nReason: x",
                  "Aspect: nobody\nScore: 5\nReason: y\nAspect: support\nscore: 15\nReason: z", "no blocks"]
ISSUE_REPLIES = ['{"issues": []}', '{"issues": [{"summary": "late", "action": "call"}]}',
                 '{"issues": [{"summary": "a", "bg_quote": "q", "competitor_quote": "c", "explanation": "e", "action": "x"}, {"summary": "b"}]}',
                 '{"issues": [{', '{"other": 1}']


def with_reply(df, replies, key="review_id"):
    """Give every row one of the replies, by its key."""
    choice = F.lit(replies[-1])
    for i, r in enumerate(replies[:-1]):
        choice = F.when(F.col(key) % len(replies) == i, F.lit(r)).otherwise(choice)
    return df.withColumn("reply", choice)


def text(value: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in value.split("\n"))


def reply_sql(replies, key="review_id"):
    cases = " ".join(f"WHEN {i} THEN {text(r)}" for i, r in enumerate(replies))
    return f"CASE {key} % {len(replies)} {cases} END"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def parsed_cols(body):
    return (f"CASE WHEN whole THEN {strip(f'''regexp_extract({body}, 'Score:\\s*(\\d+)', 1)''')} END AS raw_score, "
            f"CASE WHEN whole THEN {strip(f'''regexp_extract({body}, 'Product:\\s*([^\\n]+)', 1)''')} END AS raw_product, "
            f"CASE WHEN whole THEN {strip(f'''regexp_extract({body}, 'Reason:\\s*([^\\n]+)', 1)''')} END AS raw_reason")


def whole(body):
    return (rf"regexp_matches({body}, 'Score:\s*(\d+)') AND regexp_matches({body}, 'Product:\s*([^\n]+)') "
            rf"AND regexp_matches({body}, 'Reason:\s*([^\n]+)')")


SINGLE_CTE = V.REVIEWS_CTE + f""", r AS (SELECT review_id, {reply_sql(REPLIES)} AS reply FROM reviews),
r2 AS (SELECT *, {whole('reply')} AS whole FROM r), single AS (SELECT review_id, {parsed_cols('reply')} FROM r2)"""


def validated_sql(source, keys):
    valid = ", ".join(f"'{v}'" for v in VALID)
    salvage = "CASE " + " ".join(f"WHEN contains(raw_product, '{v}') THEN '{v}'" for v in VALID) + " END"
    return f"""SELECT {keys}, CAST(CASE WHEN bad IS NULL THEN n ELSE 0 END AS INTEGER) AS score,
  CASE WHEN bad IS NULL THEN cat ELSE 'Unknown' END AS category,
  CASE WHEN bad IS NOT NULL THEN bad WHEN length(trim(coalesce(raw_reason, ''))) > 0 THEN raw_reason
       ELSE 'No reasoning provided by AI.' END AS reason
  FROM (SELECT *, CASE WHEN n IS NULL THEN 'AI response parsing error: Response from AI did not match expected format.'
        WHEN n NOT BETWEEN 0 AND 100 THEN 'Invalid AI Response: Confidence score is outside the 0-100 range.'
        WHEN cat IS NULL THEN 'Invalid AI Response: Category ''' || raw_product || ''' is not a valid option.' END AS bad
  FROM (SELECT *, TRY_CAST(raw_score AS INTEGER) AS n,
               CASE WHEN raw_product IN ({valid}) THEN raw_product ELSE {salvage} END AS cat FROM {source}))"""


def replies(spark, sf):
    return with_reply(V.reviews(spark, sf).select("review_id"), REPLIES)


@query("prompt_column", V.rev_sql("""
SELECT review_id, md5('Assess reviews of ' || company || '.' || chr(10) || '- **A**: first' || chr(10) || '- **B**: second'
       || chr(10) || 'Review: "' || review || '"') AS digest FROM reviews"""))
def prompt_column(spark, sf):
    dim = spark.createDataFrame([(0, "A", "first"), (1, "B", "second")], "ord int, category string, definition string")
    block = E.bullet_block(dim, F.format_string("- **%s**: %s", "category", "definition"), "ord", "definitions")
    out = E.prompt_column(V.reviews(spark, sf), "Assess reviews of {company}.\n{definitions}\nReview: \"{review}\"",
                          {"company": "company", "definitions": "definitions", "review": "review"}, block)
    return out.select("review_id", F.md5("prompt").alias("digest"))


def _stand_in(prompt: str) -> str:
    """A deterministic model: it fails on some prompts and rates the others by their length."""
    if len(prompt) % 13 == 0:
        raise ValueError("busy")
    return f"Score: {len(prompt) % 131}\nProduct: Energy\nReason: length"


@query("batch_infer", V.rev_sql("""
SELECT review_id, CASE WHEN length(review) % 13 <> 0 THEN 'Score: ' || length(review) % 131
       || chr(10) || 'Product: Energy' || chr(10) || 'Reason: length' END AS reply,
       CASE WHEN length(review) % 13 = 0 THEN 'ValueError - busy' END AS error FROM reviews"""))
def batch_infer(spark, sf):
    return E.batch_infer(V.reviews(spark, sf), "review_id", "review", _stand_in)


@query("stored_replies", V.rev_sql("""
SELECT review_id, CASE WHEN length(review) % 13 <> 0 THEN 'Score: ' || length(review) % 131
       || chr(10) || 'Product: Energy' || chr(10) || 'Reason: length' END AS reply,
       CASE WHEN length(review) % 13 = 0 THEN 'ValueError - busy' END AS error FROM reviews"""))
def stored_replies(spark, sf):
    """A first run breaks off after half the prompts; the second one asks for the others only."""
    path, prompts = work_dir(spark, "replies"), V.reviews(spark, sf)
    E.stored_replies(prompts.filter("review_id % 2 = 0"), "review_id", "review", _stand_in, path)
    return E.stored_replies(prompts, "review_id", "review", _stand_in, path, rounds=2)


@query("parse_single_reply", f"WITH {SINGLE_CTE} SELECT * FROM single")
def parse_single_reply(spark, sf):
    return E.parse_single_reply(replies(spark, sf)).drop("reply")


# One reply per batch of ten reviews, with a missing, an out-of-range and a repeated number.
BATCH_HEAD = "[Review 1]\nScore: 50\nProduct: Energy\nReason: batch "
BATCH_TAIL = ("\n[Review 2]\nScore: 60\nProduct: Cars\nReason: r\n[Review 3]\nScore: 10\n[Review 99]\nScore: 1\n"
              "Product: Energy\nReason: far\n[Review 1]\nScore: 51\nProduct: Gas Products\nReason: later")


def batch_replies(spark, sf):
    """The review batches, and one reply per batch."""
    batches = R.fixed_size_batches(V.reviews(spark, sf).select("review_id"), "review_id", BATCH)
    sized = batches.groupBy("batch").agg(F.count("*").alias("size"))
    return batches, sized.withColumn("reply", F.concat(
        F.lit(BATCH_HEAD), F.col("batch").cast("string"), F.lit(BATCH_TAIL)))


BATCH_CTE = rf"""grid AS (SELECT doc_id AS review_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch,
   (row_number() OVER (ORDER BY doc_id) - 1) % {BATCH} + 1 AS index_in_batch FROM documents),
b AS (SELECT batch, count(*) AS size, {text(BATCH_HEAD)} || batch || {text(BATCH_TAIL)}
   AS reply FROM grid GROUP BY batch),
parts AS (SELECT batch, size, unnest(regexp_extract_all(reply, '\[Review (\d+)\]', 1)) AS i,
   unnest(regexp_split_to_array(reply, '\[Review \d+\]')[2:]) AS body,
   unnest(range(len(regexp_extract_all(reply, '\[Review (\d+)\]', 1)))) AS pos FROM b),
pw AS (SELECT *, CAST(i AS INTEGER) AS index_in_batch, {whole('body')} AS whole FROM parts WHERE CAST(i AS INTEGER) BETWEEN 1 AND size),
batchrep AS (SELECT batch, index_in_batch, {parsed_cols('body')} FROM pw WHERE whole
   QUALIFY row_number() OVER (PARTITION BY batch, index_in_batch ORDER BY pos DESC) = 1)"""


@query("parse_batch_reply", f"WITH {BATCH_CTE} SELECT * FROM batchrep")
def parse_batch_reply(spark, sf):
    return E.parse_batch_reply(batch_replies(spark, sf)[1], ["batch"])


@query("fill_missing_replies", f"""WITH {BATCH_CTE}, v AS ({validated_sql('batchrep', 'batch, index_in_batch')})
SELECT review_id, coalesce(score, 0) AS score, coalesce(category, 'Unknown') AS category,
       coalesce(reason, 'Missing AI response in batch') AS reason FROM grid LEFT JOIN v USING (batch, index_in_batch)""")
def fill_missing_replies(spark, sf):
    batches, sized = batch_replies(spark, sf)
    checked = E.validate_classification(E.parse_batch_reply(sized, ["batch"]), VALID)
    out = E.fill_missing_replies(batches, checked, ["batch", "index_in_batch"],
                                 {"score": 0, "category": "Unknown", "reason": E.MISSING_REPLY})
    return out.select("review_id", "score", "category", "reason")


def _aspect_model(prompt: str) -> str:
    """A deterministic model that rates each review of a batch by its length, and is busy for some batches."""
    if len(prompt) % 13 == 0:
        raise ValueError("busy")
    parts = re.split(r'(?:^|\n)\[Review (\d+)\]: "', prompt)
    blocks = []
    for number, quoted in zip(parts[1::2], parts[2::2], strict=True):
        n = len(quoted) - 1
        scores = {"speed": n % 301 - 150, "value": "N/A" if n % 2 else n % 100, "support": n % 51 - 25}
        if n % 3 == 0:
            del scores["support"]
        if n % 7:
            blocks.append(f"[Review {number}]\n" + "\n".join(
                f"Aspect: {a}\nScore: {s}\nReason: {n} characters" for a, s in scores.items()))
    return "\n".join(blocks)


MODEL_CTE = f"""grid AS (SELECT doc_id AS review_id, coalesce(text, '') AS t, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch,
   (row_number() OVER (ORDER BY doc_id) - 1) % {BATCH} + 1 AS index_in_batch FROM documents),
sized AS (SELECT *, length(t) AS n,
   (sum(length('[Review ' || index_in_batch || ']: "' || t || '"') + 1) OVER (PARTITION BY batch) - 1) % 13 = 0 AS failed FROM grid),
cells AS (SELECT *, unnest(['speed', 'value', 'support']) AS aspect FROM sized),
rated AS (SELECT *, CASE WHEN failed OR n % 7 = 0 OR (aspect = 'support' AND n % 3 = 0) THEN NULL
   WHEN aspect = 'speed' THEN CAST(n % 301 - 150 AS VARCHAR) WHEN aspect = 'support' THEN CAST(n % 51 - 25 AS VARCHAR)
   WHEN n % 2 = 1 THEN 'N/A' ELSE CAST(n % 100 AS VARCHAR) END AS raw_score, n || ' characters' AS raw_reason FROM cells)"""


def aspect_replies(spark, sf):
    """The review batches, and the model's reply for each of them, stored before anything reads it."""
    batches = R.fixed_size_batches(V.reviews(spark, sf).select("review_id", "review"), "review_id", BATCH)
    prompts = E.batch_prompts(batches)
    path = work_dir(spark, "replies")
    append_results(E.batch_infer(prompts, "batch", "prompt", _aspect_model), path)
    return batches.drop("review"), prompts.select("batch", "size").join(spark.read.parquet(path), "batch")


@query("parse_batch_aspect_reply", f"""WITH {MODEL_CTE}
SELECT batch, index_in_batch, aspect, raw_score, raw_reason FROM rated WHERE raw_score IS NOT NULL""")
def parse_batch_aspect_reply(spark, sf):
    out = E.parse_batch_aspect_reply(aspect_replies(spark, sf)[1], ["batch"], ASPECTS)
    return out.withColumn("index_in_batch", F.col("index_in_batch").cast("bigint"))


@query("enrichment_flow", f"""WITH {MODEL_CTE}
SELECT review_id, aspect, CASE WHEN TRY_CAST(raw_score AS INTEGER) BETWEEN -100 AND 100 THEN TRY_CAST(raw_score AS INTEGER) ELSE 0 END AS score,
  CASE WHEN failed THEN 'AI API call failed' WHEN raw_score IS NULL THEN 'Missing AI response in batch'
       WHEN raw_score = 'N/A' THEN 'Aspect ''' || aspect || ''' was not mentioned in the review.'
       WHEN CAST(raw_score AS INTEGER) BETWEEN -100 AND 100 THEN raw_reason
       ELSE 'Invalid AI Response: Sentiment score is outside the -100 to 100 range.' END AS reason FROM rated""")
def enrichment_flow(spark, sf):
    """Batches, prompts, model, parsing, checks and defaults; the results are appended and read again."""
    batches, replies = aspect_replies(spark, sf)
    results = E.validate_sentiment(E.parse_batch_aspect_reply(replies, ["batch"], ASPECTS))
    grid = (batches.join(replies.select("batch", "error"), "batch")
            .withColumn("aspect", F.explode(F.array(*map(F.lit, ASPECTS)))))
    out = E.fill_missing_replies(grid, results, ["batch", "index_in_batch", "aspect"],
                                 {"score": 0, "reason": E.MISSING_REPLY}, error="error")
    path = work_dir(spark, "results")
    append_results(out.select("review_id", "aspect", "score", "reason"), path)
    return spark.read.parquet(path)


ASPECT_CTE = V.REVIEWS_CTE + rf""", r AS (SELECT review_id, {reply_sql(ASPECT_REPLIES)} AS reply FROM reviews),
blk AS (SELECT review_id, string_split({strip('b')}, chr(10)) AS l, pos FROM
  (SELECT review_id, unnest(string_split(reply, 'Aspect: ')) AS b, unnest(range(len(string_split(reply, 'Aspect: ')))) AS pos FROM r)),
asp AS (SELECT review_id, pos, {strip('l[1]')} AS aspect, {strip("nullif(regexp_extract(l[2], '(?i)Score:\\s*(-?\\d+|N/A|NA)', 1), '')")} AS raw_score,
  {strip("nullif(regexp_extract(l[3], 'Reason:\\s*([^\\n]+)', 1), '')")} AS raw_reason FROM blk WHERE len(l) >= 3),
blocks AS (SELECT review_id, aspect, raw_score, raw_reason FROM asp WHERE aspect IN ('speed', 'value', 'support')
  AND raw_score IS NOT NULL AND raw_reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY review_id, aspect ORDER BY pos DESC) = 1),
sent AS (SELECT review_id, aspect,
  CASE WHEN TRY_CAST(raw_score AS INTEGER) BETWEEN -100 AND 100 THEN TRY_CAST(raw_score AS INTEGER) ELSE 0 END AS score,
  CASE WHEN lower(raw_score) IN ('n/a', 'na', 'none') THEN 'Aspect ''' || aspect || ''' was not mentioned in the review.'
       WHEN TRY_CAST(raw_score AS INTEGER) NOT BETWEEN -100 AND 100
         THEN 'Invalid AI Response: Sentiment score is outside the -100 to 100 range.' ELSE raw_reason END AS reason FROM blocks)"""


def aspect_blocks(spark, sf):
    df = with_reply(V.reviews(spark, sf).select("review_id"), ASPECT_REPLIES)
    return E.parse_aspect_blocks(df, ["review_id"], ASPECTS)


@query("parse_aspect_blocks", f"WITH {ASPECT_CTE} SELECT * FROM blocks")
def parse_aspect_blocks(spark, sf):
    return aspect_blocks(spark, sf)


@query("validate_classification", f"WITH {SINGLE_CTE} {validated_sql('single', 'review_id')}")
def validate_classification(spark, sf):
    return E.validate_classification(E.parse_single_reply(replies(spark, sf)).drop("reply"), VALID)


@query("validate_sentiment", f"WITH {ASPECT_CTE} SELECT * FROM sent")
def validate_sentiment(spark, sf):
    return E.validate_sentiment(aspect_blocks(spark, sf))


PIVOT = ", ".join(f"max(score) FILTER (WHERE aspect = '{a}') AS {a}_Score, max(reason) FILTER (WHERE aspect = '{a}') "
                  f"AS {a}_Reasoning" for a in ASPECTS)


@query("pivot_aspect_results", f"WITH {ASPECT_CTE} SELECT review_id, {PIVOT} FROM sent GROUP BY review_id")
def pivot_aspect_results(spark, sf):
    return E.pivot_aspect_results(E.validate_sentiment(aspect_blocks(spark, sf)), ["review_id"], ASPECTS)


@query("llm_category_distribution", f"""WITH {SINGLE_CTE}, v AS ({validated_sql('single', 'review_id')})
SELECT category, count(*) AS reviews FROM v GROUP BY category""")
def category_distribution(spark, sf):
    return U.volume(validate_classification(spark, sf), "category")


@query("llm_aspect_means", f"WITH {ASPECT_CTE}, p AS (SELECT review_id, {PIVOT} FROM sent GROUP BY review_id) " + " UNION ALL ".join(
    f"SELECT '{a}_Score' AS aspect, {V.tie_safe(f'avg({a}_Score)', 1)} AS value FROM p" for a in ASPECTS))
def model_aspect_means(spark, sf):
    return U.aspect_means(pivot_aspect_results(spark, sf), [f"{a}_Score" for a in ASPECTS])


@query("blank_review_passthrough", V.rev_sql(r"""
, t AS (SELECT review_id, CASE review_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE review END AS review FROM reviews)
SELECT review_id, CASE WHEN length(trim(coalesce(review, ''))) > 0 THEN length(review) % 101 END AS score,
       CASE WHEN length(trim(coalesce(review, ''))) > 0 THEN 'scored' ELSE 'No review provided' END AS reason FROM t"""))
def blank_review_passthrough(spark, sf):
    k = F.col("review_id") % 4
    body = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "  ").otherwise(F.col("review"))
    df = V.reviews(spark, sf).select("review_id", body.alias("review"))
    scorer = lambda d: d.withColumns({"score": F.length("review").cast("bigint") % 101, "reason": F.lit("scored")})
    return E.blank_review_passthrough(df, "review", scorer, ["score"], ["reason"]).drop("review")


@query("explode_issue_json", V.rev_sql(f"""
, r AS (SELECT review_id, {reply_sql(ISSUE_REPLIES)} AS reply FROM reviews),
j AS (SELECT review_id, unnest(from_json(json_extract(reply, '$.issues'), '["JSON"]')) AS i,
      generate_subscripts(from_json(json_extract(reply, '$.issues'), '["JSON"]'), 1) AS n FROM r WHERE json_valid(reply))
SELECT review_id, CAST(n AS INTEGER) AS issue_no, {", ".join(
    f"coalesce(json_extract_string(i, '$.{c}'), '') AS {c}" for c in ("summary", "bg_quote", "competitor_quote", "explanation", "action"))} FROM j"""))
def explode_issue_json(spark, sf):
    return E.explode_issue_json(with_reply(V.reviews(spark, sf).select("review_id"), ISSUE_REPLIES), ["review_id"])


@query("insight_rows", CP._grid("""
SELECT competitor, product, aspect, coalesce(printf('%.1f', o.score), 'N/A') AS sentiment_score,
       coalesce(printf('%.1f', round_even(sentiment_difference, 1)), 'N/A') AS sentiment_difference, 2024 AS year,
       competitor || ' on ' || aspect AS analysis
FROM gaps JOIN last o USING (product, aspect) WHERE o.company = 'co0'"""))
def insight_rows(spark, sf):
    sa = V.sa_monthly(spark, sf)
    ours = M.latest_scores(sa, ASPECTS).filter(F.col("company") == V.PRIMARY).drop("company")
    df = M.latest_gap(sa, V.PRIMARY, ASPECTS).join(ours, ["product", "aspect"]).withColumns({
        "year": F.lit(2024), "analysis": F.concat(F.lit(" "), "competitor", F.lit(" on "), "aspect", F.lit(" "))})
    return E.insight_rows(df, "score", "sentiment_difference", "analysis")
