"""English suffix stripping (Porter 1980) as native expressions over a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import dims
from voicegrid.functions import words as W
from voicegrid.session import broadcast_if_small, materialize

# The published suffix tables, longest suffix first within a step.
STEP_2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("ation", "ate"),
          ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("ousli", "ous"), ("entli", "ent"),
          ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
          ("ator", "ate"), ("eli", "e")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "ion", "al", "er", "ic", "ou"]

# Consonant and vowel runs; y is a vowel after a consonant.
C, V = "[^aeiou]", "[aeiouy]"
CC, VV = f"{C}[^aeiouy]*", f"{V}[aeiou]*"
M_GT_0 = f"^({CC})?{VV}{CC}"
M_EQ_1 = f"^({CC})?{VV}{CC}({VV})?$"
M_GT_1 = f"^({CC})?{VV}{CC}{VV}{CC}"
HAS_VOWEL = f"^({CC})?{V}"
CVC = f"^{CC}{V}[^aeiouwxy]$"


def _cut(word: Column, suffix: str) -> Column:
    return F.left(word, F.length(word) - len(suffix))


def _replace(word: Column, table: list[tuple[str, str]], measure: str) -> Column:
    """Longest matching suffix decides; it is replaced when the stem before it is long enough."""
    rules = F
    for suffix, new in table:
        stem = _cut(word, suffix)
        changed = F.when(stem.rlike(measure), F.concat(stem, F.lit(new))).otherwise(word)
        rules = rules.when(word.endswith(suffix), changed)
    return rules.otherwise(word)


def _plural(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _cut(w, "es")).when(w.endswith("ies"), _cut(w, "es"))
            .when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, "s")).otherwise(w))


def _past(w: Column) -> Column:
    tidy = lambda stem: (
        F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(r"([^aeiouylsz])\1$"), F.left(stem, F.length(stem) - 1))
        .when(stem.rlike(CVC), F.concat(stem, F.lit("e"))).otherwise(stem))
    ed, ing = _cut(w, "ed"), _cut(w, "ing")
    return (F.when(w.endswith("eed"), F.when(_cut(w, "eed").rlike(M_GT_0), _cut(w, "d")).otherwise(w))
            .when(w.endswith("ed") & ed.rlike(HAS_VOWEL), tidy(ed))
            .when(w.endswith("ing") & ing.rlike(HAS_VOWEL), tidy(ing)).otherwise(w))


def _final_y(w: Column) -> Column:
    stem = _cut(w, "y")
    return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _drop(w: Column) -> Column:
    rules = F
    for suffix in STEP_4:
        stem = _cut(w, suffix)
        long_enough = stem.rlike(M_GT_1)
        if suffix == "ion":
            long_enough = long_enough & stem.rlike("[st]$")
        rules = rules.when(w.endswith(suffix), F.when(long_enough, stem).otherwise(w))
    return rules.otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _cut(w, "e")
    drop = stem.rlike(M_GT_1) | (stem.rlike(M_EQ_1) & ~stem.rlike(CVC))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(M_GT_1), F.left(w, F.length(w) - 1)).otherwise(w)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters stay.

    A step mentions its input many times, so each one receives it as a lambda variable: the
    expression grows by one step at a time instead of being copied into itself.
    """
    steps = [_plural, _past, _final_y, lambda w: _replace(w, STEP_2, M_GT_0),
             lambda w: _replace(w, STEP_3, M_GT_0), _drop, _final_e, _final_ll]
    result = word
    for step in steps:
        result = F.get(F.transform(F.array(result), step), F.lit(0))
    return F.when(F.length(word) > 2, result).otherwise(word)


def stem_words(df: DataFrame, word: str, out: str = "stem") -> DataFrame:
    return df.withColumn(out, stem(F.col(word)))


def stem_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``(word, stem)`` for every distinct letters-only word of a corpus, stemmed once each."""
    words = F.filter(W.tokens(F.col(text)), lambda t: t.rlike(r"^\p{L}+$"))
    vocabulary = df.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
    return stem_words(vocabulary, "word")


def keyword_forms(df: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """``(word, aspect, stem)``: the corpus' words that share a stem with a keyword of an aspect.

    A stem differs from its word behind their common beginning by at most its last letter (``y`` to ``i``,
    an ``e`` put back), so only words that begin like a keyword's stem are stemmed, each once. Every step
    strips one suffix of a finite table, so a keyword has finitely many forms. Keywords of several words
    have no form.
    """
    stems = stem_words(keywords.select(F.col("key").alias("aspect"), F.lower("keyword").alias("_k")),
                       "_k", "stem").select("aspect", "stem").distinct()
    begin = F.left(F.col("stem"), F.greatest(F.length("stem") - 1, F.lit(1)))
    begins = stems.agg(F.collect_set(begin).alias("x")).scalar()
    near = F.filter("_w", lambda w: F.exists("_b", lambda b: F.startswith(w, b)))
    vocabulary = (df.select(F.array_distinct(W.tokens(F.col(text))).alias("_w"), begins.alias("_b"))
                  .select(F.explode(near).alias("word")).distinct().filter(F.col("word").rlike(r"^\p{L}+$")))
    return stem_words(vocabulary, "word").join(F.broadcast(stems), "stem").select("word", "aspect", "stem")


def stemmed_relevance(df: DataFrame, key: str, text: str, keywords: DataFrame | None = None) -> DataFrame:
    """``(key, aspect, relevance)``: distinct stems of a review among an aspect's keyword stems.

    Only vocabulary words whose stem is a keyword stem are joined to the corpus. They are broadcast once
    their number proves small; else the adaptive planner decides by the measured size. Pairs without a hit
    are left out.
    """
    keywords = keywords or dims.keyword_dim(df.sparkSession, dims.STEM_TERMS)
    forms = broadcast_if_small(materialize(keyword_forms(df, text, keywords)))
    words = F.array_distinct(W.tokens(F.col(text)))
    hits = df.select(key, F.explode(words).alias("word")).join(forms, "word")
    return hits.groupBy(key, "aspect").agg(F.size(F.collect_set("stem")).alias("relevance"))
