"""Numeric scores and verdicts. Rounding is half to even throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from voicegrid.dims import LONG_REVIEW_WORDS, SPAM_CONFIDENCE


def half_even(value: Column | str, places: int = 0) -> Column:
    """Round an aggregate half to even. Values of a single row are rounded as they are, by ``bround``.

    Binary noise far below the last place goes first: means of distributed sums differ in it
    from run to run, and it must not decide which way a tie falls.
    """
    return F.bround(F.bround(value, places + 7), places)


def rescale_01(score: Column) -> Column:
    """[-1, 1] to [0, 1], three places."""
    return F.bround((score + 1) / 2, 3)


def rescale_100(score: Column) -> Column:
    """[-1, 1] to [-100, 100], one place."""
    return F.bround(score * 100, 1)


def rescale_100_int(score: Column) -> Column:
    return F.bround(score * 100, 0).cast("int")


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-NULL values of a row; NULL when there is none."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
        n = n + F.when(c.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, total / n)


def length_bucket(words: Column) -> Column:
    return F.when(words < 50, "Short").when(words < 150, "Medium").otherwise("Long")


def length_score(words: Column) -> Column:
    ratio = words / F.lit(LONG_REVIEW_WORDS)
    return F.bround(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)), 3)


def spam_decision(label: Column, confidence: Column, places: int | None = None) -> Column:
    """True for a confident spam label; ``places`` rounds the confidence before the test."""
    value = confidence if places is None else F.bround(confidence, places)
    return F.coalesce((label == "spam") & (value > SPAM_CONFIDENCE), F.lit(False))


def review_weight(is_spam: Column, justified: Column, is_english: Column | None = None) -> Column:
    """0 for spam, else 1 halved when not English and times 0.9 when no reason is given."""
    weight = F.when(justified, F.lit(1.0)).otherwise(F.lit(0.9))
    if is_english is not None:
        weight = F.when(is_english, F.lit(1.0)).otherwise(F.lit(0.5)) * weight
    return F.when(is_spam, F.lit(0.0)).otherwise(weight)


def gap_verdict(gap: Column) -> Column:
    """Who leads, from the sign of (primary - competitor)."""
    return (F.when(gap.isNull(), "unavailable").when(gap > 0, "primary")
            .when(gap < 0, "competitor").otherwise("same"))


def change_verdict(change_pct: Column) -> Column:
    """A mention rate that fell by a tenth or more against its baseline is good."""
    return F.when(change_pct <= -10, "good").otherwise("bad")


def driver_verdict(ratio_pct: Column) -> Column:
    return F.when(ratio_pct > 150, "spike").otherwise("normal")


def strip_label(label: Column) -> Column:
    """Drop everything up to the first space: ``'🚿 Gas Products'`` to ``'Gas Products'``."""
    return F.regexp_replace(label, r"^\S+ ", "")


def parse_percent(text: Column) -> Column:
    return F.regexp_replace(text, "%", "").try_cast("double")
