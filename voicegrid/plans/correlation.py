"""Queries over rank correlation on ``lineitem``."""

from pyspark.sql import functions as F

from voicegrid.operators import correlate as Q
from voicegrid.plans.registry import query
from voicegrid.session import store
from voicegrid.sources.reviews import read_table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]
# Order and line alone repeat; part, supplier and quantity tell such lines apart.
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pieces"]
KEY = ", ".join(KEYS)
LOWER = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.5, 0.1, 0.86]]


def items(spark, sf):
    """Every row of ``lineitem`` with its numeric columns, under its key columns."""
    pieces = F.col("l_quantity").cast("bigint").alias("pieces")
    return read_table(spark, sf, "lineitem").select(*KEYS[:-1], pieces, *COLUMNS)


def stored_items(spark, sf):
    """The same table stored once, for operators that rank every column and read it many times."""
    return store(items(spark, sf), "items")


ITEMS_CTE = f"items AS (SELECT {', '.join(KEYS[:-1])}, CAST(l_quantity AS BIGINT) AS pieces, {', '.join(COLUMNS)} FROM lineitem)"


def each(template, sep=", "):
    return sep.join(template.replace("@", c) for c in COLUMNS)


def pairs(template, sep=" UNION ALL "):
    return sep.join(template.replace("@a", a).replace("@b", b) for a, b in Q._pairs(COLUMNS))


RANKS_CTE = ITEMS_CTE + f""", ranks AS (SELECT {KEY}, {each(
    "rank() OVER (ORDER BY @) + (count(*) OVER (PARTITION BY @) - 1) / 2.0::DOUBLE AS @")} FROM items)"""
SPEARMAN_SQL = pairs("SELECT '@a' AS col_a, '@b' AS col_b, round_even(corr(@a, @b), 6) AS corr FROM ranks")


@query("pearson_matrix", f"WITH {ITEMS_CTE} " + pairs(
    "SELECT '@a' AS col_a, '@b' AS col_b, round_even(corr(@a, @b), 6) AS corr FROM items"))
def pearson_matrix(spark, sf):
    return Q.pearson_matrix(items(spark, sf), COLUMNS)


@query("spearman_matrix", f"WITH {RANKS_CTE} {SPEARMAN_SQL}")
def spearman_matrix(spark, sf):
    return Q.spearman_matrix(stored_items(spark, sf), KEYS, COLUMNS)


@query("column_ranks", f"WITH {ITEMS_CTE} " + each(
    f"SELECT {KEY}, '@' AS series, row_number() OVER (ORDER BY @, {KEY}) AS rank FROM items", " UNION ALL "))
def column_ranks(spark, sf):
    return Q.column_ranks(stored_items(spark, sf), KEYS, COLUMNS)


MIX_CTE = ITEMS_CTE + f", mix AS (SELECT {KEY}, " + ", ".join(
    "0.0::DOUBLE + " + " + ".join(f"{COLUMNS[j]} * {LOWER[i][j]}::DOUBLE" for j in range(i + 1)) + f" AS {c}"
    for i, c in enumerate(COLUMNS)) + " FROM items)"


@query("linear_mix", f"WITH {MIX_CTE} SELECT {KEY}, {each('round_even(@, 6) AS @')} FROM mix")
def linear_mix(spark, sf):
    out = Q.linear_mix(items(spark, sf), KEYS, COLUMNS, LOWER)
    return out.select(*KEYS, *[F.bround(c, 6).alias(c) for c in COLUMNS])


# Scores for the reordering: whole numbers, so that both engines order them alike.
MIXED = "(l_orderkey % 1000003 * 31 + l_linenumber * 17 + l_partkey % 1000003 * 7 + l_suppkey % 1000003 * 3 + pieces) % 1000003"
PRIMES = (7919, 104729, 15485863)
SCORES_CTE = ITEMS_CTE + f""", scores AS (SELECT {KEY}, {", ".join(
    f"({MIXED} * {p}) % 1000003 AS {c}" for c, p in zip(COLUMNS, PRIMES))} FROM items)"""


def scores(df):
    return df.select(*KEYS, *[F.expr(f"({MIXED} * {p}) % 1000003").alias(c) for c, p in zip(COLUMNS, PRIMES)])


REORDER_CTE = SCORES_CTE + "".join(f""",
s_{c} AS (SELECT {KEY}, row_number() OVER (ORDER BY {c}, {KEY}) AS r FROM scores),
v_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}, {KEY}) AS r FROM items),
y_{c} AS (SELECT {KEY}, v AS {c} FROM s_{c} JOIN v_{c} USING (r))""" for c in COLUMNS) + f""",
after AS (SELECT {KEY}, """ + each("@") + " FROM y_" + " JOIN y_".join(
    c if i == 0 else f"{c} USING ({KEY})" for i, c in enumerate(COLUMNS)) + ")"


def reordered(df):
    return Q.rank_reorder(df, KEYS, COLUMNS, scores(df))


@query("rank_reorder", f"WITH {REORDER_CTE} SELECT * FROM after")
def rank_reorder(spark, sf):
    return reordered(stored_items(spark, sf))


@query("correlation_band", f"""WITH {RANKS_CTE}, m AS ({SPEARMAN_SQL})
SELECT *, CASE WHEN corr > 0.5 THEN 'strong' WHEN corr > 0 THEN 'mild' WHEN corr < -0.5 THEN 'strong opposite'
               WHEN corr < 0 THEN 'mild opposite' ELSE 'independent' END AS band FROM m""")
def correlation_band(spark, sf):
    return Q.correlation_band(Q.spearman_matrix(stored_items(spark, sf), KEYS, COLUMNS))


@query("matrix_gap", f"""WITH {RANKS_CTE}, s AS ({SPEARMAN_SQL}), p AS ({pairs(
    "SELECT '@a' AS col_a, '@b' AS col_b, round_even(corr(@a, @b), 6) AS corr FROM items")})
SELECT round_even(max(abs(s.corr - p.corr)), 6) AS max_abs_gap FROM s JOIN p USING (col_a, col_b)""")
def matrix_gap(spark, sf):
    df = stored_items(spark, sf)
    out = Q.matrix_gap(Q.spearman_matrix(df, KEYS, COLUMNS), Q.pearson_matrix(df, COLUMNS))
    return out.select(F.bround("max_abs_gap", 6).alias("max_abs_gap"))


CO_SQL = pairs(f"""SELECT '@a' AS col_a, '@b' AS col_b, round_even(b, 6) AS before, round_even(a, 6) AS after,
  round_even(a - b, 6) AS change FROM
  (SELECT avg(CAST(@a > q_@a AND @b > q_@b AS DOUBLE)) AS b FROM items, cuts),
  (SELECT avg(CAST(@a > q_@a AND @b > q_@b AS DOUBLE)) AS a FROM after, cuts)""")


@query("co_exceedance", f"""WITH {REORDER_CTE},
cuts AS (SELECT {each("quantile_cont(@, 0.9) AS q_@")} FROM after) {CO_SQL}""")
def co_exceedance(spark, sf):
    df = items(spark, sf)  # read from the table each time: a stored copy would only take disk
    return Q.co_exceedance(df, reordered(df), COLUMNS)


@query("marginal_summary", f"WITH {ITEMS_CTE} " + each("""
SELECT '@' AS series, round_even(avg(@), 2) AS mean, round_even(stddev_pop(@), 2) AS std, round_even(min(@), 2) AS min,
       round_even(max(@), 2) AS max FROM items""", " UNION ALL "))
def marginal_summary(spark, sf):
    return Q.marginal_summary(items(spark, sf), COLUMNS, 2)


@query("trend_line", f"""WITH {ITEMS_CTE} SELECT round_even(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round_even(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM items""")
def trend_line(spark, sf):
    return Q.trend_line(items(spark, sf), "l_quantity", "l_extendedprice", 4)
