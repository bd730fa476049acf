"""Queries over corpus-level text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voicegrid import dims
from voicegrid.functions import scores as S
from voicegrid.operators import annotate as A, lexicon as X, rank as R, rollups as U, stem as P, textjobs as T
from voicegrid.plans import views as V
from voicegrid.plans.registry import query
from voicegrid.plans.rollups import ASPECTS, REL_CTE, TOPICS, each, relevant
from voicegrid.session import materialize
from voicegrid.sources.reviews import read_table

STOP_WORDS = ["is", "it", "to"]


@query("token_set", V.ann_sql(r"""
, t AS (SELECT review_id, list_distinct(list_filter(toks, lambda t: regexp_matches(t, '^\p{L}+$'))) AS s FROM ann)
SELECT review_id, CAST(len(s) AS INTEGER) AS n_tokens, md5(array_to_string(list_sort(s), ' ')) AS digest FROM t"""))
def token_set(spark, sf):
    df = T.token_set(V.reviews(spark, sf), "review")
    return df.select("review_id", F.size("tokens").alias("n_tokens"),
                     F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("digest"))


@query("aspect_relevance", f"WITH {REL_CTE} SELECT review_id, {each('relevance_@')} FROM rel")
def aspect_relevance(spark, sf):
    return relevant(spark, sf).select("review_id", *[f"relevance_{a}" for a in ASPECTS])


@query("topic_keyword_counts", V.ann_sql(f"SELECT review_id, {each('kw_@', TOPICS)} FROM ann"))
def topic_keyword_counts(spark, sf):
    return A.topic_keyword_counts(V.reviews(spark, sf), "review", V.TOPICS).select(
        "review_id", *[f"kw_{t}" for t in TOPICS])


@query("aspect_mention_weight", V.ann_sql(f"SELECT review_id, {each('w_@')} FROM ann"))
def aspect_mention_weight(spark, sf):
    return A.aspect_mention_weight(V.reviews(spark, sf), "review", V.ASPECTS).select(
        "review_id", *[f"w_{a}" for a in ASPECTS])


QUERY_TERMS = ", ".join(f"('{a}', '{w}')" for a, ws in V.ASPECTS.items() for w in ws if w not in STOP_WORDS)


COSINE_SQL = rf"""WITH t AS (SELECT review_id, unnest(regexp_extract_all(lower(review), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM reviews),
tf AS (SELECT review_id, term, count(*) AS tf FROM t WHERE term NOT IN ('is', 'it', 'to') GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM reviews)) / (1 + CAST(count(*) AS DOUBLE))) + 1 AS idf
        FROM tf GROUP BY term),
w AS (SELECT review_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT review_id, sqrt(sum(w * w)) AS n FROM w GROUP BY review_id),
k(aspect, term) AS (VALUES {QUERY_TERMS}),
q AS (SELECT aspect, term, idf AS q FROM k JOIN idf USING (term)),
qn AS (SELECT aspect, sqrt(sum(q * q)) AS n FROM q GROUP BY aspect),
dots AS (SELECT review_id, aspect, sum(w * q) AS d FROM w JOIN q USING (term) GROUP BY ALL),
c AS (SELECT review_id, aspect, d / norm.n / qn.n AS c FROM dots JOIN norm USING (review_id) JOIN qn USING (aspect))
SELECT review_id, {each("round_even(coalesce(max(c) FILTER (WHERE aspect = '@'), 0), 9) AS relevance_@")}
FROM reviews LEFT JOIN c USING (review_id) GROUP BY review_id"""


@query("tfidf_aspect_cosine", f"WITH {V.REVIEWS_CTE}, cosine AS ({COSINE_SQL}) SELECT * FROM cosine")
def tfidf_aspect_cosine(spark, sf):
    out = T.tfidf_aspect_cosine(V.reviews(spark, sf), "review_id", "review", V.ASPECTS, STOP_WORDS)
    return out.withColumns({f"relevance_{a}": F.bround(f"relevance_{a}", 9) for a in ASPECTS})


# The cosine relevance of every aspect, on which medians, thresholds and distributions are tried with continuous values.
COSINE_CTE = V.SCORED_CTE + ", cosine AS (" + COSINE_SQL + ")"


def cosine_relevance(spark, sf):
    """Scored reviews with their cosine relevance, stored once: thresholds read it several times."""
    rel = tfidf_aspect_cosine(spark, sf)
    return materialize(V.scored(V.reviews(spark, sf)).drop("review").join(rel, "review_id"))


@query("cosine_median_threshold", f"WITH {COSINE_CTE} SELECT {each('round_even(median(relevance_@), 12) AS median_@')} FROM cosine")
def cosine_median_threshold(spark, sf):
    out = U.aspect_median_threshold(cosine_relevance(spark, sf), ASPECTS)
    return out.withColumns({c: F.bround(c, 12) for c in out.columns})


@query("cosine_threshold_rollup", f"""WITH {COSINE_CTE}, m AS (SELECT {each('median(relevance_@) AS m_@')} FROM cosine),
r AS (SELECT scored.*, cosine.*, greatest({each('relevance_@')}) AS top FROM scored JOIN cosine USING (review_id)),
share AS (SELECT month, product, company, {each('relevance_@')}, {each('CASE WHEN top > 0 THEN sentiment * (relevance_@ / top) ELSE 0.0 END AS s_@')} FROM r)
SELECT month, product, company,
       {each('round_even(avg(s_@) FILTER (WHERE relevance_@ >= m_@), 9) AS @_sentiment_score, count(*) FILTER (WHERE relevance_@ >= m_@) AS count_relevant_@')}
FROM share, m GROUP BY month, product, company""")
def cosine_threshold_rollup(spark, sf):
    out = U.threshold_aspect_rollup(T.relevance_share_sentiment(cosine_relevance(spark, sf), "sentiment", ASPECTS), ASPECTS)
    return out.withColumns({f"{a}_sentiment_score": S.half_even(F.col(f"{a}_sentiment_score"), 9) for a in ASPECTS})


WORDS = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v, r in V.LEXICON if r == "word")
AROUND = ", ".join(f"('{t}', {v}::DOUBLE, '{r}')" for t, v, r in V.LEXICON if r in ("booster", "negator"))


def _phrase(role: str, *places: str) -> str:
    """SQL for the value of a phrase made of the words at some places, NULL if there is none."""
    cases = " ".join(f"WHEN '{t}' THEN {v}::DOUBLE" for t, v, r in V.LEXICON if r == role and t.count(" ") == len(places) - 1)
    words = " || ' ' || ".join(f"lower({p})" for p in places)
    return f"(CASE {words} {cases} END)" if cases else "NULL::DOUBLE"


PUNCT = r"[!-/:-@\[-`{-~]"


def compound_ctes(source: str, keys: str, text: str) -> str:
    """The lexicon rules as SQL over ``source``, grouped by ``keys``; neighbours come from lag()."""
    def step(d: int, damp: float) -> str:
        loud = (f"CASE WHEN mixed AND upper(p{d}) = p{d} AND lower(p{d}) <> p{d} "
                "THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END")
        return (f"CASE WHEN a{d}.role = 'booster' THEN ((CASE WHEN v < 0 THEN -1 ELSE 1 END) * a{d}.val + {loud}) * {damp} "
                "ELSE 0 END")
    so = lambda p: f"coalesce(list_contains({V._list(V.SPECIAL.so)}, lower({p})), false)"
    never = {1: "false", 2: f"coalesce(lower(p2) = '{V.SPECIAL.never}', false) AND {so('p1')}",
             3: f"coalesce(lower(p3) = '{V.SPECIAL.never}', false) AND ({so('p1')} OR {so('p2')})"}
    neg = lambda d: f"CASE WHEN {never[d]} THEN 1.25::DOUBLE WHEN a{d}.role = 'negator' THEN -0.74::DOUBLE ELSE 1 END"
    k = [x.strip() for x in keys.split(",")]
    part = ", ".join(k)
    value = "(v + CASE WHEN mixed AND upper(w) = w AND lower(w) <> w THEN CASE WHEN v < 0 THEN -0.733 ELSE 0.733 END ELSE 0 END)"
    for d, damp in ((1, "1.0::DOUBLE"), (2, "0.95::DOUBLE"), (3, "0.9::DOUBLE")):
        value = f"(({value} + {step(d, damp)}) * {neg(d)})"
    idiom = ", ".join(_phrase("idiom", *p) for p in (("p1", "w"), ("p2", "p1", "w"), ("w", "n1"), ("w", "n1", "n2")))
    more = " + ".join(f"coalesce({_phrase('booster', *p)}, 0)" for p in (("p3", "p2", "p1"), ("p3", "p2"), ("p2", "p1")))
    least = (f"CASE WHEN lower(p1) = '{V.SPECIAL.least}' AND NOT coalesce(list_contains({V._list(V.SPECIAL.not_least)}, lower(p2)), false) "
             "THEN -0.74::DOUBLE ELSE 1 END")
    value = f"((coalesce({idiom}, {value}) + {more}) * {least})"
    return rf"""
lex(tok, v) AS (VALUES {WORDS}), around(tok, val, role) AS (VALUES {AROUND}),
pieces AS (SELECT {part}, {text} AS body, list_filter(regexp_split_to_array(coalesce({text}, ''), '[\s\p{{Z}}]+'), lambda x: x <> '') AS ws FROM {source}),
bare AS (SELECT {part}, body, list_transform(ws, lambda x: CASE WHEN length(regexp_replace(x, '^{PUNCT}+|{PUNCT}+$', '', 'g')) <= 2 THEN x
              ELSE regexp_replace(x, '^{PUNCT}+|{PUNCT}+$', '', 'g') END) AS ws FROM pieces),
head AS (SELECT *, list_position(list_transform(ws, lambda x: lower(x)), 'that') AS turn,
             len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) AS caps,
             len(regexp_extract_all(body, '!')) AS bangs, len(regexp_extract_all(body, '\?')) AS asks FROM bare),
emph AS (SELECT {part}, coalesce(least(bangs, 4) * 0.292::DOUBLE + CASE WHEN asks <= 1 THEN 0 WHEN asks <= 3 THEN asks * 0.18::DOUBLE ELSE 0.96 END, 0) AS emph FROM head),
flat AS (SELECT {part}, turn, caps > 0 AND caps < len(ws) AS mixed, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM head),
near AS (SELECT *, {", ".join(f"lag(w, {d}) OVER (PARTITION BY {part} ORDER BY pos) AS p{d}" for d in (1, 2, 3))},
  {", ".join(f"lead(w, {d}) OVER (PARTITION BY {part} ORDER BY pos) AS n{d}" for d in (1, 2))} FROM flat),
vals AS (SELECT near.*, {value} * CASE WHEN pos < turn AND turn > 0 THEN 0.5::DOUBLE WHEN pos > turn AND turn > 0 THEN 1.5::DOUBLE ELSE 1 END AS val
  FROM near JOIN lex ON lex.tok = lower(w)
  {" ".join(f"LEFT JOIN around a{d} ON a{d}.tok = lower(p{d})" for d in (1, 2, 3))}),
tot AS (SELECT {part}, sum(val) AS s FROM vals GROUP BY {part}),
summed AS (SELECT {", ".join(f"e.{x} AS {x}" for x in k)}, coalesce(s, 0) + sign(coalesce(s, 0)) * emph AS s FROM emph e LEFT JOIN tot t ON {" AND ".join(f"e.{x} = t.{x}" for x in k)}),
compound AS (SELECT {part}, round_even(s / sqrt(s * s + 15), 4) AS compound FROM summed)"""


@query("lexicon_compound", V.rev_sql(f", {compound_ctes('reviews', 'review_id', 'review')} SELECT * FROM compound"))
def lexicon_compound(spark, sf):
    return X.lexicon_compound(V.reviews(spark, sf), "review_id", "review", dims.lexicon_dim(spark, V.LEXICON), special=V.SPECIAL)


@query("compound_distribution", V.rev_sql(f""", {compound_ctes('reviews', 'review_id', 'review')}
SELECT company, count(*) AS n, min(compound) AS minimum, round_even(quantile_cont(compound, 0.25), 9) AS q1, round_even(quantile_cont(compound, 0.5), 9) AS median,
       round_even(quantile_cont(compound, 0.75), 9) AS q3, max(compound) AS maximum
FROM compound JOIN reviews USING (review_id) GROUP BY company"""))
def compound_distribution(spark, sf):
    """The lexicon scores of each company's reviews as a five-number summary; the company is part of the key, so nothing is joined."""
    df = V.reviews(spark, sf).select("review_id", "company", "review")
    scores = X.lexicon_compound(df, ["review_id", "company"], "review", dims.lexicon_dim(spark, V.LEXICON), special=V.SPECIAL)
    out = U.score_distribution(scores, "company", "compound")
    return out.withColumns({c: F.bround(c, 9) for c in ("q1", "median", "q3")})


@query("lexicon_polarity", V.ann_sql(f"""
, lex(term, v) AS (VALUES {WORDS}), t AS (SELECT review_id, unnest(toks) AS term FROM ann),
a AS (SELECT review_id, avg(v) AS p FROM t JOIN lex USING (term) GROUP BY review_id)
SELECT review_id, round_even(coalesce(p, 0), 6) AS polarity FROM ann LEFT JOIN a USING (review_id)"""))
def lexicon_polarity(spark, sf):
    return X.lexicon_polarity(V.reviews(spark, sf), "review_id", "review", dims.lexicon_dim(spark, V.LEXICON))


def _cut(n):
    return f"left(s, length(s) - {n})"


def _is(stem, pattern):
    return f"regexp_matches({stem}, '{pattern}')"


def _suffix_rules(table, measure):
    cases = " ".join(f"WHEN ends_with(s, '{x}') THEN CASE WHEN {_is(_cut(len(x)), measure)} THEN {_cut(len(x))} || '{new}' "
                     "ELSE s END" for x, new in table)
    return f"CASE {cases} ELSE s END"


def _tidy(stem):
    double = f"(length({stem}) > 1 AND right({stem}, 1) = left(right({stem}, 2), 1) AND NOT {_is(f'right({stem}, 1)', '[aeiouylsz]')})"
    return (f"CASE WHEN {_is(stem, '(at|bl|iz)$')} THEN {stem} || 'e' WHEN {double} THEN left({stem}, length({stem}) - 1) "
            f"WHEN {_is(stem, P.CVC)} THEN {stem} || 'e' ELSE {stem} END")


STEM_STEPS = [
    f"CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN {_cut(2)} WHEN ends_with(s, 'ss') THEN s "
    f"WHEN ends_with(s, 's') THEN {_cut(1)} ELSE s END",
    f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_is(_cut(3), P.M_GT_0)} THEN {_cut(1)} ELSE s END "
    f"WHEN ends_with(s, 'ed') AND {_is(_cut(2), P.HAS_VOWEL)} THEN {_tidy(_cut(2))} "
    f"WHEN ends_with(s, 'ing') AND {_is(_cut(3), P.HAS_VOWEL)} THEN {_tidy(_cut(3))} ELSE s END",
    f"CASE WHEN ends_with(s, 'y') AND {_is(_cut(1), P.HAS_VOWEL)} THEN {_cut(1)} || 'i' ELSE s END",
    _suffix_rules(P.STEP_2, P.M_GT_0), _suffix_rules(P.STEP_3, P.M_GT_0),
    "CASE " + " ".join(
        f"WHEN ends_with(s, '{x}') THEN CASE WHEN {_is(_cut(len(x)), P.M_GT_1)}"
        + (f" AND {_is(_cut(3), '[st]$')}" if x == "ion" else "") + f" THEN {_cut(len(x))} ELSE s END"
        for x in P.STEP_4) + " ELSE s END",
    f"CASE WHEN ends_with(s, 'e') AND ({_is(_cut(1), P.M_GT_1)} OR ({_is(_cut(1), P.M_EQ_1)} AND NOT {_is(_cut(1), P.CVC)})) "
    f"THEN {_cut(1)} ELSE s END",
    f"CASE WHEN ends_with(s, 'll') AND {_is('s', P.M_GT_1)} THEN {_cut(1)} ELSE s END",
]


def stem_ctes(source: str, out: str) -> str:
    """The suffix steps as SQL, one query per step, over the ``word`` column of ``source``."""
    ctes, prev = [], f"(SELECT word, word AS s FROM {source})"
    for i, step in enumerate(STEM_STEPS):
        ctes.append(f"{out}{i} AS (SELECT word, CASE WHEN length(word) > 2 THEN {step} ELSE s END AS s FROM {prev})")
        prev = f"{out}{i}"
    return ", ".join(ctes) + f", {out} AS (SELECT word, s AS stem FROM {prev})"


VOCAB_CTE = V.ANN_CTE + r""", used AS (SELECT DISTINCT review_id, unnest(toks) AS word FROM ann),
vocab AS (SELECT DISTINCT word FROM used WHERE regexp_matches(word, '^\p{L}+$')), """ + stem_ctes("vocab", "stems")
STEM_KEYWORDS = {"motion": ["ation", "ationed", "tions"], "doing": ["ing", "inging"], "here": ["thered", "ores", "andly"]}


@query("stem_vocabulary", f"WITH {VOCAB_CTE} SELECT word, stem FROM stems")
def stem_vocabulary(spark, sf):
    return P.stem_vocabulary(V.reviews(spark, sf), "review")


@query("stemmed_relevance", f"""WITH {VOCAB_CTE}, k(aspect, word) AS (VALUES {", ".join(
    f"('{a}', '{w}')" for a, ws in STEM_KEYWORDS.items() for w in ws)}), {stem_ctes("k", "keys")},
ks AS (SELECT DISTINCT aspect, stem FROM k JOIN keys USING (word))
SELECT review_id, aspect, CAST(count(DISTINCT stem) AS INTEGER) AS relevance
FROM used JOIN stems USING (word) JOIN ks USING (stem) GROUP BY ALL""")
def stemmed_relevance(spark, sf):
    keywords = dims.keyword_dim(spark, STEM_KEYWORDS)
    return P.stemmed_relevance(V.reviews(spark, sf), "review_id", "review", keywords)


# Keywords whose other forms occur in the texts too.
STEMMED_ASPECTS = {"speed": ["the", "tions"], "value": ["with", "ationed"], "support": ["it", "was", "inging"]}


def scoped_cte() -> str:
    """The sentences of each aspect by stems, over the vocabulary of all texts."""
    keys = ", ".join(f"('{a}', '{w}')" for a, ws in STEMMED_ASPECTS.items() for w in ws)
    per_aspect = " UNION ALL ".join(rf"""SELECT review_id, '{a}' AS aspect, nullif(array_to_string(list_filter(ss, lambda s:
    list_has_any(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), known)), '. '), '') AS scoped
    FROM cut, (SELECT coalesce(list(word), []) AS known FROM forms WHERE aspect = '{a}')""" for a in STEMMED_ASPECTS)
    return VOCAB_CTE + rf""", kw(aspect, word) AS (VALUES {keys}), {stem_ctes("kw", "kws")},
forms AS (SELECT DISTINCT aspect, stems.word FROM kw JOIN kws ON kw.word = kws.word JOIN stems ON stems.stem = kws.stem),
cut AS (SELECT review_id, list_filter(list_transform(regexp_extract_all(review, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ss FROM reviews),
scoped AS ({per_aspect}), {compound_ctes('scoped', 'review_id, aspect', 'scoped')},
precise AS (SELECT review_id, aspect, md5(scoped) AS digest, CASE WHEN scoped IS NOT NULL THEN compound END AS sentiment
  FROM scoped JOIN compound USING (review_id, aspect))"""


@query("sentence_scoped_sentiment", f"WITH {scoped_cte()} SELECT * FROM precise")
def sentence_scoped_sentiment(spark, sf):
    return X.sentence_scoped_sentiment(V.reviews(spark, sf), "review_id", "review", STEMMED_ASPECTS,
                                       dims.lexicon_dim(spark, V.LEXICON), V.SPECIAL)


@query("monthly_precise_rollup", f"""WITH {scoped_cte()},
p AS (SELECT month, company, product, aspect, review_id, {V.tie_safe('precise.sentiment * 100', 1)} AS s FROM precise JOIN scored USING (review_id))
SELECT month, company, product, count(DISTINCT review_id) AS reviews,
       {each("round_even(avg(s) FILTER (WHERE aspect = '@'), 9) AS @_sentiment_score, round_even(stddev_samp(s) FILTER (WHERE aspect = '@'), 6) AS @_volatility",
             list(STEMMED_ASPECTS))}
FROM p GROUP BY month, company, product""")
def monthly_precise_rollup(spark, sf):
    reviews = V.scored(V.reviews(spark, sf)).select("review_id", "month", "company", "product", "review")
    scores = X.sentence_scoped_sentiment(reviews, ["review_id", "month", "company", "product"], "review", STEMMED_ASPECTS,
                                         dims.lexicon_dim(spark, V.LEXICON), V.SPECIAL)
    out = U.monthly_precise_rollup(scores, list(STEMMED_ASPECTS))
    return out.withColumns({f"{a}_{s}": S.half_even(F.col(f"{a}_{s}"), 9 if s == "sentiment_score" else 6)
                            for a in STEMMED_ASPECTS for s in ("sentiment_score", "volatility")})


LANG_CTE = V.REVIEWS_CTE + r""", word AS (
  SELECT review_id, product, ' ' || unnest(regexp_extract_all(lower(review), '\p{L}+')) || ' ' AS p FROM reviews),
g AS (SELECT review_id, product, unnest(list_transform(range(1, greatest(length(p) - 1, 2)),
                                                       lambda i: substring(p, i, 3))) AS gram FROM word),
c AS (SELECT product AS lang, gram, count(*) AS c FROM g GROUP BY ALL),
prof AS (SELECT lang, gram, c / CAST(sum(c) OVER (PARTITION BY lang) AS DOUBLE) AS share FROM c),
sc AS (SELECT review_id, lang, round_even(sum(share), 9) AS s FROM g JOIN prof USING (gram) GROUP BY ALL),
best AS (SELECT review_id, lang FROM sc QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY s DESC, lang DESC) = 1)"""


@query("language_tag", f"""WITH {LANG_CTE}
SELECT review_id, coalesce(lang, 'unknown') AS detected_lang, coalesce(lang, '') = 'en' AS is_english
FROM reviews LEFT JOIN best USING (review_id)""")
def language_tag(spark, sf):
    df = V.reviews(spark, sf)
    return T.language_tag(df, "review_id", "review", T.language_profiles(df, "review", "product"))


@query("spam_score", V.rev_sql(r"""
, tf AS (SELECT review_id, term, count(*) AS tf FROM (
    SELECT review_id, unnest(regexp_extract_all(lower(review), '[\p{L}\p{N}_]+')) AS term FROM reviews) GROUP BY ALL),
lab AS (SELECT review_id, toxic FROM reviews JOIN labels ON doc_id = review_id WHERE toxic IS NOT NULL),
odds AS (SELECT ln((count(*) FILTER (WHERE toxic > 0) + 1) / (count(*) FILTER (WHERE toxic <= 0) + 1)) AS prior FROM lab),
c AS (SELECT term, coalesce(sum(tf) FILTER (WHERE toxic > 0), 0) AS spam, coalesce(sum(tf) FILTER (WHERE toxic <= 0), 0) AS ham
      FROM tf JOIN lab USING (review_id) GROUP BY term),
t AS (SELECT sum(spam) + count(*) AS spam, sum(ham) + count(*) AS ham FROM c),
w AS (SELECT term, ln((c.spam + 1) / t.spam) - ln((c.ham + 1) / t.ham) AS weight FROM c, t),
s AS (SELECT review_id, sum(tf * weight) AS s FROM tf JOIN w USING (term) GROUP BY review_id),
o AS (SELECT review_id, prior + coalesce(s, 0) AS o FROM odds, reviews LEFT JOIN s USING (review_id))
SELECT review_id, CASE WHEN o > 0 THEN 'spam' ELSE 'ham' END AS spam_label,
       round_even(1 / (1 + exp(-abs(o))), 3) AS spam_confidence FROM o"""))
def spam_score(spark, sf):
    """Train on all labelled documents, score every document; ``toxic`` stands in for a spam label."""
    docs = V.reviews(spark, sf)
    labels = read_table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), "toxic")
    train = docs.join(labels, "review_id")
    model = T.fit_spam_model(train, "review", "toxic")
    return T.spam_score_with_model(docs, "review_id", "review", model)


@query("token_budget", """
WITH e AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 80),
t AS (SELECT conv_id, string_agg(turn || ': ' || text, chr(10) ORDER BY turn) AS body FROM e GROUP BY conv_id)
SELECT conv_id, CAST(ceil(length(body) / 4.0) AS BIGINT) AS estimated_tokens,
       md5(substring(body, 1, 800)) AS digest FROM t""")
def token_budget(spark, sf):
    """Evidence of at most 80 turns per conversation, cut to a budget of 200 tokens."""
    turns = R.top_n(read_table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], T.reviews_per_side())
    line = F.concat(F.col("turn").cast("string"), F.lit(": "), "text")
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    body = turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("body"))
    out = T.token_budget(body, "body", 200)
    return out.select("conv_id", "estimated_tokens", F.md5("context").alias("digest"))
