"""Rule-based sentiment from a valence lexicon.

The rules and constants are those published for rule-based social-media sentiment (Hutto and
Gilbert, ICWSM 2014). The lexicon is an input table, ``(token, valence, role)``; role is word, booster,
negator, contrast or idiom.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import dims
from voicegrid.functions import words as W
from voicegrid.operators import stem as P
from voicegrid.session import broadcast_if_small

# Fixed values of the published rules.
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
CAPITALS_BOOST = 0.733
NEGATION_FACTOR = -0.74
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS, MAX_QUESTIONS = 0.18, 0.96, 3
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
NEVER_SO = 1.25
ALPHA = 15.0
PUNCTUATION = string.punctuation


@dataclass(frozen=True)
class Words:
    """The words of the rules that no lexicon row states: ``least`` negates what follows unless one of
    ``not_least`` stands before it; ``never`` before one of ``so`` strengthens instead of negating."""

    least: str = "least"
    not_least: Sequence[str] = ("at", "very")
    never: str = "never"
    so: Sequence[str] = ("so", "this")


def _pieces(text: Column) -> Column:
    """White-space pieces without surrounding punctuation; emoticon-sized remains stay whole."""
    def bare(piece: Column) -> Column:
        core = F.btrim(piece, F.lit(PUNCTUATION))
        return F.when(F.length(core) <= 2, piece).otherwise(core)
    return F.transform(W.chunks(text), bare)


def _is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _emphasis(text: Column) -> Column:
    bangs = F.least(F.regexp_count(text, F.lit("!")), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
    asks = F.regexp_count(text, F.lit(r"\?"))
    return bangs + (F.when(asks <= 1, 0.0).when(asks <= MAX_QUESTIONS, asks * QUESTION)
                    .otherwise(MANY_QUESTIONS))


def lexicon_compound(df: DataFrame, key: str | Sequence[str], text: str, lexicon: DataFrame,
                     out: str = "compound", special: Words = Words()) -> DataFrame:
    """``(key, compound)`` in [-1, 1]; text without lexicon words scores 0.

    Tokens of two or three words are phrases. An idiom gives its own valence to a lexicon word that it begins
    or ends with, whatever stands around (of several the first: ending here, two words before three, then
    beginning here); a phrase that is a booster adds its value to a lexicon word right behind it or one word on.

    Every word is exploded beside its text's list of words, from which the neighbours of lexicon words are read, so
    boosters and negations are found by lookups within one stage, broadcast once the lexicon proves small. What is
    summed per text is fixed-width, and partial sums leave each task as one row per text; no sort and no window is involved.
    """
    keys = [key] if isinstance(key, str) else list(key)
    lexicon = broadcast_if_small(lexicon)
    words = lexicon.filter(F.col("role") == "word").select(
        F.col("token").alias("_token"), F.col("valence").alias("_v"))
    prepared = df.select(
        *keys, _pieces(F.col(text)).alias("_w"),
        F.coalesce(_emphasis(F.col(text)), F.lit(0.0)).alias("_emph"))
    contrast = lexicon.filter(F.col("role") == "contrast").agg(F.collect_set("token").alias("x")).scalar()
    lowered = F.transform("_w", F.lower)
    upper = F.size(F.filter("_w", _is_upper))
    prepared = prepared.withColumn("_contrast", contrast).select(
        *keys, "_emph", "_w",
        # Capitals only matter when some but not all words are capitalised.
        ((upper > 0) & (upper < F.size("_w"))).alias("_mixed"),
        F.array_min(F.filter(F.transform("_contrast", lambda c: F.array_position(lowered, c)),
                             lambda p: p > 0)).alias("_turn"))
    rows = prepared.select("*", F.posexplode_outer("_w").alias("_at", "_word")).withColumn("_pos", F.col("_at") + 1)
    phrases = lexicon.filter(F.col("token").contains(" "))
    idioms, phrase_boosters = (phrases.filter(F.col("role") == role).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "valence"))).alias("x")).scalar() for role in ("idiom", "booster"))
    rows = rows.withColumns({"_idioms": idioms, "_phrases": phrase_boosters})
    hits = rows.withColumn("_token", F.lower("_word")).join(words, "_token", "left")
    # Only words of the lexicon go on, and one row of each text whether it has any or not.
    hits = hits.filter(F.col("_v").isNotNull() | (F.coalesce("_at", F.lit(0)) == 0))
    # Neighbours are read from the text's words, and only around words of the lexicon.
    hits = hits.withColumns({name: F.when(F.col("_v").isNotNull(), F.get("_w", F.col("_at") + d)) for name, d in (
        ("_p1", -1), ("_p2", -2), ("_p3", -3), ("_n1", 1), ("_n2", 2))})
    around = lexicon.filter(F.col("role").isin("booster", "negator"))
    for d in (1, 2, 3):
        side = around.select(F.col("token").alias(f"_t{d}"), F.col("valence").alias(f"_m{d}"),
                             F.col("role").alias(f"_r{d}"))
        hits = hits.withColumn(f"_t{d}", F.lower(f"_p{d}")).join(side, f"_t{d}", "left")
    value = F.col("_v")
    sign = F.when(F.col("_v") < 0, -1.0).otherwise(1.0)
    value = value + F.when(F.col("_mixed") & _is_upper(F.col("_word")), sign * CAPITALS_BOOST).otherwise(0.0)
    for d in (1, 2, 3):
        boost = sign * F.col(f"_m{d}")
        loud = F.when(F.col("_mixed") & _is_upper(F.col(f"_p{d}")),
                      F.when(F.col("_v") > 0, CAPITALS_BOOST).otherwise(-CAPITALS_BOOST)).otherwise(0.0)
        value = value + F.when(F.col(f"_r{d}") == "booster",
                               (boost + loud) * DISTANCE_DAMPING[d - 1]).otherwise(0.0)
        never = F.lit(False)
        if d > 1:
            close = [F.lower(f"_p{k}").isin(list(special.so)) for k in range(1, d)]
            never = F.coalesce((F.lower(f"_p{d}") == special.never) & functools.reduce(lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), close), F.lit(False))
        value = value * F.when(never, NEVER_SO).when(F.col(f"_r{d}") == "negator", NEGATION_FACTOR).otherwise(1.0)

    def phrase(table: str, *places: str) -> Column:
        """The value of the phrase made of the words at some places; NULL where the text is not that long."""
        there = functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ("_v", *places)])
        return F.when(there, F.try_element_at(table, F.lower(F.concat_ws(" ", *places))))

    value = F.coalesce(phrase("_idioms", "_p1", "_word"), phrase("_idioms", "_p2", "_p1", "_word"),
                       phrase("_idioms", "_word", "_n1"), phrase("_idioms", "_word", "_n1", "_n2"), value)
    for places in (("_p3", "_p2", "_p1"), ("_p3", "_p2"), ("_p2", "_p1")):
        value = value + F.coalesce(phrase("_phrases", *places), F.lit(0.0))
    spared = F.coalesce(F.lower("_p2").isin(list(special.not_least)), F.lit(False))
    value = value * F.when((F.lower("_p1") == special.least) & ~spared, NEGATION_FACTOR).otherwise(1.0)
    value = value * (F.when(F.col("_pos") < F.col("_turn"), BEFORE_CONTRAST)
                     .when(F.col("_pos") > F.col("_turn"), AFTER_CONTRAST).otherwise(1.0))
    total = F.coalesce(F.sum(value), F.lit(0.0))
    sums = hits.groupBy(*keys).agg(total.alias("_s"), F.max("_emph").alias("_emph"))
    s = F.col("_s") + F.signum("_s") * F.col("_emph")
    return (sums.withColumn("_s", s)
            .select(*keys, F.bround(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + ALPHA), 4).alias(out)))


def lexicon_polarity(df: DataFrame, key: str, text: str, lexicon: DataFrame,
                     out: str = "polarity") -> DataFrame:
    """``(key, polarity)``: mean valence of the lexicon words in a text, 0 when there is none."""
    words = broadcast_if_small(lexicon).filter(F.col("role") == "word").select("token", "valence")
    hits = (df.select(key, F.explode_outer(W.tokens(F.col(text))).alias("token"))
            .join(words, "token", "left"))
    return hits.groupBy(key).agg(
        F.bround(F.coalesce(F.avg("valence"), F.lit(0.0)), 6).alias(out))


def aspect_sentences(df: DataFrame, key: str | Sequence[str], text: str,
                     terms: Mapping[str, Sequence[str]] = dims.STEM_TERMS) -> DataFrame:
    """``(key, aspect, scoped)``: the sentences that name the aspect, joined by ``". "``; NULL if none.

    A sentence names an aspect when the stem of one of its words is the stem of a keyword. The corpus'
    vocabulary is stemmed once; what each row sees is the list of forms of every aspect's keywords, a scalar
    as large as the dictionary times the suffixes. Keywords of several words name nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    forms = P.keyword_forms(df, text, dims.keyword_dim(df.sparkSession, terms))
    lists = forms.groupBy("aspect").agg(F.collect_set("word").alias("words"))
    known = lists.agg(F.map_from_entries(F.collect_list(F.struct("aspect", "words"))).alias("x")).scalar()
    cut = df.select(*keys, F.transform(W.sentences(F.col(text)), lambda s: F.struct(s.alias("s"), W.tokens(s).alias("t"))).alias("_s"), known.alias("_f"))

    def scoped(aspect: str) -> Column:
        words = F.coalesce(F.get(F.array(F.try_element_at("_f", F.lit(aspect))), F.lit(0)), F.array().cast("array<string>"))
        kept = F.filter("_s", lambda s: F.arrays_overlap(s["t"], words))
        return F.nullif(F.array_join(F.transform(kept, lambda s: s["s"]), ". "), F.lit(""))  # no sentence is empty

    rows = F.array(*[F.struct(F.lit(a).alias("aspect"), scoped(a).alias("scoped")) for a in terms])
    return cut.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.aspect", "_r.scoped")


def sentence_scoped_sentiment(df: DataFrame, key: str | Sequence[str], text: str, terms: Mapping[str, Sequence[str]],
                              lexicon: DataFrame, special: Words = Words()) -> DataFrame:
    """``(key, aspect, digest, sentiment)`` of the sentences that name each aspect; NULL if none does.

    ``digest`` is the MD5 of the scoped text. Further columns of a review can be part of ``key``: they then
    go with the scores, and a rollup needs no join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    scoped = aspect_sentences(df, keys, text, terms).withColumn("digest", F.md5("scoped"))
    scores = lexicon_compound(scoped, [*keys, "aspect", "digest"], "scoped", lexicon, "_c", special)
    return scores.select(*keys, "aspect", "digest", F.when(F.col("digest").isNotNull(), F.col("_c")).alias("sentiment"))
