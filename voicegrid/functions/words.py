"""Words, phrases and substrings in review text.

A word is a run of letters, digits and underscores in any script. Word edges are spelled out
as look-arounds over that class, because the meaning of ``\\b`` changes between JDK releases.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]"
GAP = r"[\s\p{Z}]+"
SENTENCE = r"[^.!?]+[.!?]*"


def tokens(text: Column) -> Column:
    """Lower-case words of ``text`` in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def chunks(text: Column) -> Column:
    """White-space separated pieces of ``text``; NULL and blank text give an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences of ``text`` without the white space around them; blank ones are left out."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")


def any_of(terms: Sequence[str]) -> str:
    return "|".join(re.escape(t) for t in terms)


def word_pattern(terms: Sequence[str]) -> str:
    """Pattern of whole-word (or whole-phrase) matches of any term."""
    return f"(?<!{WORD})(?:{any_of(terms)})(?!{WORD})"


def single_words(terms: Sequence[str]) -> bool:
    return all(re.fullmatch(r"\w+", t) for t in terms)


def split_terms(terms: Sequence[str]) -> tuple[list[str], list[str]]:
    """Lower-case single words, and the terms that need a pattern."""
    lowered = [t.lower() for t in terms]
    return [t for t in lowered if single_words([t])], [t for t in lowered if not single_words([t])]


def known_words(text: Column, *term_lists: Sequence[str]) -> Column:
    """The words of ``text`` that occur in any dictionary, in order.

    Serves as ``toks`` for all of those dictionaries: each then looks at a few words per text.
    """
    wanted = sorted({w for terms in term_lists for w in split_terms(terms)[0]})
    return F.filter(tokens(text), in_list(wanted))


def in_list(words: Sequence[str]):
    """Predicate for ``F.filter`` / ``F.exists``; long lists become a hash set in the plan."""
    def test(item: Column) -> Column:
        return item.isin(list(words))
    return test


def has_word(text: Column, terms: Sequence[str], toks: Column | None = None) -> Column:
    """True where a whole word or phrase occurs, in any case; False for NULL text.

    Here and below, ``toks`` is the text's word list where a caller has it already. Patterns are
    slow, so one is only run on a text that contains a phrase somewhere.
    """
    singles, phrases = split_terms(terms)
    found = F.lit(False)
    if singles:
        found = F.exists(tokens(text) if toks is None else toks, in_list(singles))
    if phrases:
        found = found | (has_substring(text, phrases) & F.lower(text).rlike(word_pattern(phrases)))
    return F.coalesce(found, F.lit(False))


def has_substring(text: Column, terms: Sequence[str]) -> Column:
    """True where a term occurs anywhere, in any case; False for NULL text."""
    found = F.lit(False)
    lowered = F.lower(text)
    for term in terms:
        found = found | F.contains(lowered, F.lit(term.lower()))
    return F.coalesce(found, F.lit(False))


def count_words(text: Column, terms: Sequence[str], toks: Column | None = None) -> Column:
    """Non-overlapping whole-word hits of any term; a phrase counts once. NULL text gives 0.

    A text without any of the phrases is counted by its words alone.
    """
    singles, phrases = split_terms(terms)
    hits = F.size(F.filter(tokens(text) if toks is None else toks, in_list(singles))) if singles else F.lit(0)
    if phrases:
        by_pattern = F.regexp_count(F.lower(text), F.lit(word_pattern([t.lower() for t in terms])))
        hits = F.when(has_substring(text, phrases), by_pattern).otherwise(hits)
    return F.coalesce(hits, F.lit(0)).cast("int")


def count_each(text: Column, terms: Sequence[str], toks: Column | None = None) -> Column:
    """Sum of the hits of every term on its own, so ``power cut`` also counts as ``power``."""
    singles, phrases = split_terms(terms)
    total = count_words(text, singles, toks) if singles else F.lit(0)
    for phrase in phrases:
        total = total + count_words(text, [phrase])
    return total
