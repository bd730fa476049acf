"""Queries over weekly series and emerging risk."""

from pyspark.sql import functions as F

from voicegrid.operators import risk as K
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.plans.rollups import tidy
from voicegrid.sources.reviews import read_table

WEEK = "CAST(date + CAST((8 - isodow(date)) % 7 AS INTEGER) AS DATE)"
SPINE = """, spine AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w)"""


@query("weekly_flag_sum", V.ann_sql(f"""
, w AS (SELECT {WEEK} AS week, CAST(sum(promo_flag) AS BIGINT) AS total FROM ann GROUP BY ALL){SPINE}
SELECT week, coalesce(total, 0) AS total FROM spine LEFT JOIN w USING (week)"""))
def weekly_flag_sum(spark, sf):
    return K.weekly_flag_sum(V.annotated(spark, sf), "promo_flag")


@query("weekly_sentiment_mean", V.scored_sql(f"""
, w AS (SELECT {WEEK} AS week, avg(score) AS mean FROM scored
        WHERE company = 'co1' AND product = 'es' GROUP BY ALL){SPINE}
SELECT week, round_even(mean, 12) AS mean FROM spine LEFT JOIN w USING (week)"""))
def weekly_sentiment_mean(spark, sf):
    df = V.reviews(spark, sf).filter("company = 'co1' AND product = 'es'")
    return tidy(K.weekly_mean(df, "score"), "mean")


@query("weekly_mentions", V.rev_sql(f"""
, w AS (SELECT {WEEK} AS week, count(*) AS mentions FROM reviews
        WHERE contains(lower(review), 'tionth') OR contains(lower(review), 'ingin') GROUP BY ALL){SPINE}
SELECT week, coalesce(mentions, 0) AS mentions FROM spine LEFT JOIN w USING (week)"""))
def weekly_mentions(spark, sf):
    return K.weekly_mentions(V.reviews(spark, sf), "review", ["tionth", "INGIN"])


@query("weekly_event_mentions", f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS date FROM events WHERE contains(lower(props), '"k": 1')),
w AS (SELECT {WEEK} AS week, count(*) AS mentions FROM e GROUP BY ALL){SPINE}
SELECT week, coalesce(mentions, 0) AS mentions FROM spine LEFT JOIN w USING (week)""")
def weekly_event_mentions(spark, sf):
    events = read_table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return K.weekly_mentions(events, "props", ['"k": 1'])


def _weight(column="low"):
    return " + ".join(f"CASE WHEN contains({column}, '{k}') THEN {v}::DOUBLE ELSE 0 END" for k, v in V.RISK.items())


AGED = ", aged AS (SELECT *, date_diff('day', date, (SELECT max(date) FROM ann)) AS age FROM ann)"


@query("recent_vs_baseline", V.ann_sql(f"""{AGED},
m AS (SELECT age < 7 AS recent, {_weight()} AS w, sentiment FROM aged WHERE age < 97),
r AS (SELECT coalesce(sum(w) FILTER (WHERE recent), 0) AS recent_count, coalesce(sum(w) FILTER (WHERE NOT recent), 0) AS base_count,
      avg(sentiment) FILTER (WHERE recent) AS recent_sentiment, avg(sentiment) FILTER (WHERE NOT recent) AS base_sentiment
      FROM m WHERE w > 0), x AS (SELECT *, base_count * 7 / 90 AS scaled FROM r)
SELECT recent_count, base_count, {V.tie_safe('scaled', 1)} AS base_avg, round_even(recent_count / nullif(scaled, 0), 9) AS rate_ratio,
       round_even((recent_count / nullif(scaled, 0) - 1) * 100, 6) AS change_pct,
       CASE WHEN (recent_count / nullif(scaled, 0) - 1) * 100 <= -10 THEN 'good' ELSE 'bad' END AS verdict,
       round_even(recent_sentiment, 9) AS recent_sentiment, round_even(base_sentiment, 9) AS base_sentiment FROM x"""))
def recent_vs_baseline(spark, sf):
    out = K.recent_vs_baseline(V.scored(V.reviews(spark, sf)), "review", V.RISK)
    return out.withColumns({c: F.bround(c, p) for c, p in (
        ("rate_ratio", 9), ("change_pct", 6), ("recent_sentiment", 9), ("base_sentiment", 9))})


@query("risk_drivers", V.ann_sql(f"""{AGED}, k(keyword) AS (VALUES {", ".join(f"('{k}')" for k in V.RISK)}),
m AS (SELECT keyword, age < 7 AS recent, sentiment FROM aged, k WHERE age < 97 AND contains(low, keyword)),
s AS (SELECT keyword, count(*) FILTER (WHERE recent) AS recent_count, count(*) FILTER (WHERE NOT recent) AS b,
      avg(sentiment) FILTER (WHERE recent) - avg(sentiment) FILTER (WHERE NOT recent) AS sent_diff FROM m GROUP BY keyword),
r AS (SELECT *, recent_count / nullif(b * 7 / 90.0::DOUBLE, 0) AS ratio FROM s)
SELECT keyword, recent_count, round_even(ratio, 9) AS ratio, round_even(sent_diff, 9) AS sent_diff,
       CASE WHEN ratio * 100 > 150 THEN 'spike' ELSE 'normal' END AS level
FROM r ORDER BY ratio DESC NULLS LAST, keyword LIMIT 3"""))
def risk_drivers(spark, sf):
    out = K.risk_drivers(V.scored(V.reviews(spark, sf)), "review", list(V.RISK))
    return out.withColumns({c: F.bround(c, 9) for c in ("ratio", "sent_diff")})


RISK_ROWS = ", ".join(f"('{r}', '{k}', {w}::DOUBLE)" for r, m in V.RISKS.items() for k, w in m.items())


@query("risk_overview", V.ann_sql(f"""{AGED}, k(risk, keyword, w) AS (VALUES {RISK_ROWS}),
h AS (SELECT review_id, risk, keyword, w, age < 7 AS recent, sentiment FROM aged, k WHERE age < 97 AND contains(low, keyword)),
m AS (SELECT review_id, risk, any_value(recent) AS recent, any_value(sentiment) AS sentiment, sum(w) AS w FROM h GROUP BY ALL),
a AS (SELECT risk, coalesce(sum(w) FILTER (WHERE recent), 0) AS recent_count, coalesce(sum(w) FILTER (WHERE NOT recent), 0) AS base_count,
      avg(sentiment) FILTER (WHERE recent) AS recent_sentiment, avg(sentiment) FILTER (WHERE NOT recent) AS base_sentiment FROM m GROUP BY risk),
s AS (SELECT risk, keyword, count(*) FILTER (WHERE recent) AS n, count(*) FILTER (WHERE NOT recent) * 7 / 90.0::DOUBLE AS b FROM h GROUP BY ALL),
d AS (SELECT *, n / nullif(b, 0) AS ratio, row_number() OVER (PARTITION BY risk ORDER BY n / nullif(b, 0) DESC NULLS LAST, keyword) AS place FROM s),
l AS (SELECT risk, string_agg(keyword || ':' || n, ', ' ORDER BY place) AS drivers FROM d WHERE place <= 3 GROUP BY risk)
SELECT r.risk, coalesce(recent_count, 0) AS recent_count, coalesce(base_count, 0) AS base_count,
       round_even(recent_count / nullif(base_count * 7 / 90, 0), 9) AS rate_ratio,
       CASE WHEN (recent_count / nullif(base_count * 7 / 90, 0) - 1) * 100 <= -10 THEN 'good' ELSE 'bad' END AS verdict,
       round_even(recent_sentiment, 9) AS recent_sentiment, round_even(base_sentiment, 9) AS base_sentiment, coalesce(drivers, '') AS drivers
FROM (SELECT DISTINCT risk FROM k) r LEFT JOIN a USING (risk) LEFT JOIN l USING (risk)"""))
def risk_overview(spark, sf):
    out = K.risk_overview(V.scored(V.reviews(spark, sf)), "review", V.RISKS).drop("base_avg", "change_pct")
    drivers = F.array_join(F.transform("drivers", lambda d: F.concat(d["keyword"], F.lit(":"), d["recent_count"].cast("string"))), ", ")
    return out.withColumns({c: F.bround(c, 9) for c in ("rate_ratio", "recent_sentiment", "base_sentiment")} | {"drivers": F.coalesce(drivers, F.lit(""))})


@query("sentiment_shift", V.ann_sql(f"""{AGED},
s AS (SELECT company, avg(score) FILTER (WHERE age < 7) AS r, avg(score) FILTER (WHERE age >= 7) AS b
      FROM aged WHERE age < 97 GROUP BY company)
SELECT company, round_even(r, 12) AS recent_sentiment, round_even(b, 12) AS base_sentiment,
       round_even((r - b) * 100, 9) AS shift_points FROM s"""))
def sentiment_shift(spark, sf):
    out = K.sentiment_shift(V.reviews(spark, sf), sentiment="score", keys=["company"])
    return tidy(out, "recent_sentiment", "base_sentiment").withColumn("shift_points", F.bround("shift_points", 9))


@query("event_sentiment_shift", """
WITH e AS (SELECT *, date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) AS age FROM events),
s AS (SELECT event_type, avg(value) FILTER (WHERE age < 7) AS r, avg(value) FILTER (WHERE age >= 7) AS b
      FROM e WHERE age < 28 GROUP BY event_type)
SELECT event_type, round_even(r, 6) AS recent_sentiment, round_even(b, 6) AS base_sentiment,
       round_even((r - b) * 100, 4) AS shift_points FROM s""")
def event_sentiment_shift(spark, sf):
    events = read_table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    out = K.sentiment_shift(events, sentiment="value", base=21, keys=["event_type"])
    return out.withColumns({"recent_sentiment": F.bround("recent_sentiment", 6),
                            "base_sentiment": F.bround("base_sentiment", 6),
                            "shift_points": F.bround("shift_points", 4)})
