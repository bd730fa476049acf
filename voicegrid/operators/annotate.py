"""Row annotation: every derived column of an annotated review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from voicegrid import dims
from voicegrid.functions import dates as D, labels as L, scores as S, words as W
from voicegrid.session import broadcast_if_small


def topic_keyword_counts(df: DataFrame, text: str, terms: Mapping[str, Sequence[str]] = dims.TOPIC_TERMS,
                         prefix: str = "kw_", toks: str | None = None) -> DataFrame:
    """One ``kw_<topic>`` hit count per topic.

    All topics share one list of dictionary words, ``toks`` where the table has it already.
    """
    df = df.withColumn("_hits", F.col(toks) if toks else W.known_words(F.col(text), *terms.values()))
    return df.select(*[c for c in df.columns if c != "_hits"], *[
        W.count_words(F.col(text), ts, F.col("_hits")).alias(f"{prefix}{k}") for k, ts in terms.items()])


def aspect_mention_weight(df: DataFrame, text: str,
                          terms: Mapping[str, Sequence[str]] = dims.MENTION_TERMS,
                          toks: str | None = None) -> DataFrame:
    """Hits per aspect in any case, 0 for NULL text, as ``w_<aspect>``."""
    return topic_keyword_counts(df, text, terms, "w_", toks)


def topic_coverage(df: DataFrame, counts: Sequence[str], out: str = "topic_cov_n") -> DataFrame:
    """Share of the corpus-wide largest keyword total, 3 places; all zero when nobody mentions any."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts[1:]), F.coalesce(F.col(counts[0]), F.lit(0)))
    top = df.agg(F.coalesce(F.nullif(F.max(total), F.lit(0)), F.lit(1)).alias("x")).scalar()
    return df.withColumn(out, S.half_even(total / top, 3))


@dataclass(frozen=True)
class Dictionaries:
    """The word lists that annotation reads. Where a mapping gives one label, its first match counts."""

    topics: Mapping[str, Sequence[str]] = field(default_factory=lambda: dims.TOPIC_TERMS)
    aspects: Mapping[str, Sequence[str]] = field(default_factory=lambda: dims.MENTION_TERMS)
    categories: Mapping[str, Sequence[str]] = field(default_factory=lambda: dims.CATEGORY_TERMS)
    debit: Sequence[str] = tuple(dims.DEBIT_TERMS)
    prepay: Sequence[str] = tuple(dims.PREPAY_TERMS)
    own_brand: str | None = dims.OWN_BRAND
    gas: Sequence[str] = tuple(dims.GAS_TERMS)
    power: Sequence[str] = tuple(dims.POWER_TERMS)
    fixed: Sequence[str] = L.FIXED_TERMS
    variable: Sequence[str] = L.VARIABLE_TERMS
    intent: Sequence[str] = tuple(dims.INTENT_TERMS)
    outcome: Sequence[str] = tuple(dims.OUTCOME_TERMS)
    reasons: Sequence[str] = tuple(dims.REASON_TERMS_SHORT)
    meter: Sequence[str] = ("smart meter", "smart meters")
    promo: Sequence[str] = tuple(dims.PROMO_TERMS)
    regulatory: Sequence[str] = tuple(dims.REGULATORY_TERMS)
    channels: Sequence[str] = tuple(dims.CHANNELS)

    def word_lists(self) -> list[Sequence[str]]:
        """The lists whose terms are whole words: they share one list of a text's known words."""
        return [*self.topics.values(), *self.aspects.values(), self.debit, self.prepay, self.gas, self.power,
                self.fixed, self.variable, self.reasons, self.channels]


QUALITY_FACTORS = ("topic_cov_n", "length_score", "justification", "promo_flag", "reg_ref_flag")


def annotate(df: DataFrame, text: str = "review", date: str = "date", words: Dictionaries = Dictionaries(),
             sentiments: Sequence[str] = (), spam: str | None = None, english: Column | None = None) -> DataFrame:
    """All columns of an annotated review in one lazy projection.

    Month and year; topic counts ``kw_*``, mention weights ``w_*`` and topic coverage; length, its bucket and
    score; payment, fuel, tariff, switching stage, category, flags and channels; ``<s>_n`` for each column of
    ``sentiments`` in [-1, 1]; the review weight from the boolean column ``spam`` (none: no spam) and
    ``english`` (none: language does not count); the quality score, the mean of the normalised sentiments,
    topic coverage, length score and three flags.

    The text is cut into words once for all dictionaries. Topic coverage compares with the largest keyword
    total of the table; that scalar, as everything else, is only computed for queries that read it.
    """
    body, toks = F.col(text), F.col("_toks")
    df = df.withColumn("_toks", W.known_words(body, *words.word_lists()))
    df = topic_keyword_counts(df, text, words.topics, toks="_toks")
    df = aspect_mention_weight(df, text, words.aspects, toks="_toks")
    df = df.withColumns({
        "month": D.month_start(F.col(date)),
        "year": F.year(date),
        "word_count": F.size(W.chunks(body)),
        "payment_method": L.payment_method(body, words.debit, words.prepay, toks),
        "fuel_type": L.fuel_type(body, words.own_brand, words.gas, words.power, toks),
        "tariff_type": L.tariff_type(body, words.fixed, words.variable, toks),
        "switching": L.switching_stage(body, words.intent, words.outcome),
        "category": L.first_category(body, words.categories),
        "justification": L.flag(L.justification(body, words.reasons, toks)),
        "smart_meter_flag": L.smart_meter_flag(body, words.meter),
        "promo_flag": L.promo_flag(body, words.promo),
        "reg_ref_flag": L.regulatory_flag(body, words.regulatory),
        **L.channel_flags(body, words.channels, toks),
        **{f"{s}_n": S.rescale_01(F.col(s)) for s in sentiments},
    }).drop("_toks")
    df = topic_coverage(df, [f"kw_{t}" for t in words.topics])
    is_spam = F.coalesce(F.col(spam), F.lit(False)) if spam else F.lit(False)
    df = df.withColumns({"length_cat": S.length_bucket(F.col("word_count")),
                         "length_score": S.length_score(F.col("word_count")),
                         "review_weight": S.review_weight(is_spam, F.col("justification") == 1, english)})
    return quality_score(df, [*[f"{s}_n" for s in sentiments], *QUALITY_FACTORS])


def quality_score(df: DataFrame, factors: Sequence[str], out: str = "quality_score") -> DataFrame:
    """Mean of the factors that are present, 3 places."""
    return df.withColumn(out, S.half_even(S.row_mean([F.col(c) for c in factors]), 3))


def risk_flags(df: DataFrame, green_count: str = "kw_green", switching: str = "switching") -> DataFrame:
    return df.withColumns({"green_flag": (F.coalesce(F.col(green_count), F.lit(0)) > 0).cast("int"),
                           "switch_flag": F.col(switching).isin("Intent", "Outcome").cast("int")})


def match_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({f"{c}_key": F.lower(F.trim(c)) for c in columns})


def canonical_spelling(df: DataFrame, column: str, order: str, out: str | None = None) -> DataFrame:
    """Replace every spelling by the one first seen for its trimmed lower-case form.

    Rows are first reduced to one per spelling, with fixed-width buffers that aggregate map-side;
    the lookup then has one row per name. Its measured size decides at run time whether it is
    broadcast, so rows of a hot name stay where they are unless names are very many.
    """
    key = F.lower(F.trim(column))
    spellings = df.groupBy(key.alias("_key"), column).agg(F.min(order).alias("_at"))
    first = spellings.groupBy("_key").agg(F.min_by(column, "_at").alias("_first"))
    return (df.withColumn("_key", key).join(first, "_key", "left")
            .withColumn(out or column, F.col("_first")).drop("_key", "_first"))


def label_lookup(df: DataFrame, column: str, labels: DataFrame | None = None, out: str = "label") -> DataFrame:
    """Display label of a code (of a product unless ``labels`` says otherwise); a code without label stands for itself."""
    labels = labels or dims.label_dim(df.sparkSession, dims.PRODUCT_LABELS)
    labels = labels.select(F.col("code").alias(column), F.col("label").alias("_label"))
    return (df.join(broadcast_if_small(labels), column, "left").withColumn(out, F.coalesce("_label", F.col(column)))
            .drop("_label"))
