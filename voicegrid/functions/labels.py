"""Categories and flags read off the review text; all are native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from voicegrid import dims
from voicegrid.functions import words as W


def flag(condition: Column) -> Column:
    return condition.cast("int")


def justification(text: Column, terms: Sequence[str] = dims.REASON_TERMS,
                  toks: Column | None = None) -> Column:
    return W.has_word(text, terms, toks)


def payment_method(text: Column, debit: Sequence[str] = dims.DEBIT_TERMS,
                   prepay: Sequence[str] = dims.PREPAY_TERMS, toks: Column | None = None) -> Column:
    return (F.when(W.has_word(text, debit, toks), "Direct Debit")
            .when(W.has_word(text, prepay, toks), "Prepayment Meter")
            .otherwise("Other/Unspecified"))


def fuel_type(text: Column, own_brand: str | None = dims.OWN_BRAND,
              gas: Sequence[str] = dims.GAS_TERMS, power: Sequence[str] = dims.POWER_TERMS,
              toks: Column | None = None) -> Column:
    """The fuel named more often once the company's own name is taken out of the text."""
    g, p = W.count_each(text, gas, toks), W.count_each(text, power, toks)
    if own_brand:
        named = W.has_substring(text, [own_brand])
        body = F.regexp_replace(F.lower(text), W.word_pattern([own_brand.lower()]), "")
        g = F.when(named, W.count_each(body, gas)).otherwise(g)
        p = F.when(named, W.count_each(body, power)).otherwise(p)
    return F.when(g > p, "Gas Supply").when(p > g, "Electricity").otherwise("Unknown")


FIXED_TERMS, VARIABLE_TERMS = ("fixed",), ("variable", "tracker")


def tariff_type(text: Column, fixed: Sequence[str] = FIXED_TERMS,
                variable: Sequence[str] = VARIABLE_TERMS, toks: Column | None = None) -> Column:
    return (F.when(W.has_word(text, fixed, toks), "Fixed")
            .when(W.has_word(text, variable, toks), "Variable").otherwise("Unknown"))


def switching_stage(text: Column, intent: Sequence[str] = dims.INTENT_TERMS,
                    outcome: Sequence[str] = dims.OUTCOME_TERMS) -> Column:
    return (F.when(W.has_substring(text, intent), "Intent")
            .when(W.has_substring(text, outcome), "Outcome").otherwise("None"))


def smart_meter_flag(text: Column, phrases: Sequence[str] = ("smart meter", "smart meters")) -> Column:
    return flag(W.has_word(text, phrases))


def promo_flag(text: Column, terms: Sequence[str] = dims.PROMO_TERMS) -> Column:
    return flag(W.has_substring(text, terms))


def regulatory_flag(text: Column, terms: Sequence[str] = dims.REGULATORY_TERMS) -> Column:
    return flag(W.has_substring(text, terms))


def channel_flags(text: Column, channels: Sequence[str] = dims.CHANNELS,
                  toks: Column | None = None) -> dict[str, Column]:
    return {f"channel_{c}": flag(W.has_word(text, [c], toks)) for c in channels}


def first_category(text: Column, terms: Mapping[str, Sequence[str]] = dims.CATEGORY_TERMS,
                   default: str = "other") -> Column:
    """First category, in dictionary order, with a keyword somewhere in the text."""
    chosen = F.lit(None).cast("string")
    for category, keywords in reversed(list(terms.items())):
        chosen = F.when(W.has_substring(text, keywords), F.lit(category)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(default))
