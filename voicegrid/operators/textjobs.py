"""Corpus-level text jobs: token sets, relevance, TF-IDF, language and spam scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid import dims
from voicegrid.functions import scores as S, words as W
from voicegrid.session import materialize, store


def token_set(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """Distinct lower-case words made of letters only."""
    words = F.filter(W.tokens(F.col(text)), lambda t: t.rlike(r"^\p{L}+$"))
    return df.withColumn(out, F.coalesce(F.array_distinct(words), F.array().cast("array<string>")))


def aspect_relevance(df: DataFrame, token_column: str, terms: Mapping[str, Sequence[str]],
                     prefix: str = "relevance_") -> DataFrame:
    """Number of an aspect's keywords in the token set. Multi-word keywords never match."""
    return df.withColumns({
        f"{prefix}{a}": F.size(F.filter(token_column, W.in_list(sorted(set(t.lower() for t in ts)))))
        for a, ts in terms.items()})


def term_counts(df: DataFrame, key: str, text: str, pattern: str = r"[\p{L}\p{N}_]{2,}",
                stop_words: Sequence[str] = ()) -> DataFrame:
    """``(key, term, tf)`` over the full vocabulary; terms have two or more word characters.

    Counting happens inside the row: words are sorted and the lengths of equal runs are read off,
    so nothing is shuffled. A text without any term keeps one row with a NULL term and a count of 0.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda t: ~t.isin(list(stop_words)))
    # A lambda's variable is computed once per row, however often its body reads it.
    runs = F.transform(F.array(F.sort_array(words)), _run_lengths)[0]
    rows = df.select(key, F.explode_outer(runs).alias("_r"))
    return rows.select(key, F.col("_r.term").alias("term"), F.coalesce("_r.tf", F.lit(0)).cast("bigint").alias("tf"))


def _run_lengths(words: Column) -> Column:
    """``[(term, tf)]`` of a sorted list."""
    marked = F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i))
    starts = F.filter(marked, lambda i: i.isNotNull())
    ends = F.transform(F.array(starts), lambda s: F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(words))))[0]
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).alias("tf")))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def with_topic_scores(df: DataFrame, text: str, terms: Mapping[str, Sequence[str]], prefix: str = "tfidf_") -> DataFrame:
    """Add the sum of the L2-normalised TF-IDF weights of each topic's words as ``tfidf_<topic>``, 3 places.

    The vocabulary is the dictionary itself. Its document frequencies are one row of sums over the table, read
    as a scalar; each text's weights are then computed within its row, so nothing is exploded or joined.
    Phrases of a dictionary cannot match single words and weigh nothing.
    """
    vocabulary = sorted({t.lower() for ts in terms.values() for t in ts if len(t) > 1 and W.single_words([t])})
    place = {t: i for i, t in enumerate(vocabulary)}
    hits = F.filter(W.tokens(F.col(text)), W.in_list(vocabulary))
    counts = F.transform(F.array(hits), lambda h: F.array(*[F.size(F.filter(h, W.in_list([t]))) for t in vocabulary]))[0]
    if not vocabulary:
        return df.withColumns({f"{prefix}{a}": F.lit(0.0) for a in terms})
    counted = df.withColumn("_c", F.coalesce(counts, F.array_repeat(F.lit(0), len(vocabulary))))
    idf = counted.agg(F.array(*[smooth_idf(F.count("*"), F.count_if(F.col("_c")[i] > 0)) for i in range(len(vocabulary))]).alias("x")).scalar()
    weighted = counted.withColumn("_idf", idf).withColumn("_w", F.zip_with("_c", "_idf", lambda c, w: c * w))
    norm = F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, w: s + w * w))
    scores = {}
    for a, ts in terms.items():
        total = F.lit(0.0)
        for t in sorted({t.lower() for t in ts} & set(vocabulary)):
            total = total + F.col("_w")[place[t]]
        scores[f"{prefix}{a}"] = F.when(F.col("_n") > 0, S.half_even(total / F.col("_n"), 3)).otherwise(F.lit(0.0))
    return weighted.withColumn("_n", norm).withColumns(scores).drop("_c", "_idf", "_w", "_n")


def tfidf_topic_score(df: DataFrame, key: str, text: str, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(key, tfidf_<topic> ...)`` of every review; see ``with_topic_scores``."""
    return with_topic_scores(df, text, terms).select(key, *[f"tfidf_{a}" for a in terms])


HOT_TERMS = 1024


def with_document_frequency(counts: DataFrame, dfreq: DataFrame, key: str,
                            hot: int = HOT_TERMS) -> DataFrame:
    """Attach ``df`` to every ``(key, term)`` row of an unbounded vocabulary without skew."""
    return with_term_value(counts, dfreq, key, "df", "df", hot)


def with_term_value(counts: DataFrame, terms: DataFrame, key: str, size: str, value: str,
                    hot: int = HOT_TERMS) -> DataFrame:
    """Attach the ``value`` column of ``terms`` to every ``(key, term)`` row without skew.

    The ``hot`` terms with the largest ``size`` are broadcast: that table has a fixed number of rows. Their
    rows, and those without a term, are resolved where they are; only rows of other terms take part in the
    shuffled join. ``counts`` and ``terms`` are read twice, so they should be stored.
    """
    top = terms.orderBy(F.desc(size), "term").limit(hot).select("term", F.col(value).alias("_hot"))
    marked = counts.join(F.broadcast(top), "term", "left")
    resolved = marked.filter(F.col("_hot").isNotNull() | F.col("term").isNull())
    others = counts.filter(F.col("term").isNotNull()).join(F.broadcast(top.select("term")), "term", "left_anti")
    found = others.join(terms.select("term", value), "term", "left")
    return (resolved.select(*counts.columns, F.col("_hot").alias(value))
            .unionByName(found.select(*counts.columns, value)))


def tfidf_aspect_cosine(df: DataFrame, key: str, text: str, terms: Mapping[str, Sequence[str]] = dims.COSINE_TERMS,
                        stop_words: Sequence[str] = ()) -> DataFrame:
    """Cosine of each review with each aspect's keyword string, over the full vocabulary."""
    counts = store(term_counts(df, key, text, stop_words=stop_words), "term-counts")
    dfreq = store(document_frequency(counts), "document-frequency")
    n = df.agg(F.count("*").alias("n")).scalar()
    queries = _keyword_vectors(df.sparkSession, terms, stop_words)
    in_corpus = dfreq.join(F.broadcast(queries), "term").withColumn(
        "q", F.col("qtf") * smooth_idf(n, F.col("df")))
    norms = in_corpus.groupBy("aspect").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    vectors = in_corpus.join(F.broadcast(norms), "aspect").select(
        "term", "aspect", (F.col("q") / F.col("qnorm")).alias("q"))
    # One row per keyword, with a column for every aspect: bounded by the dictionary.
    wide = vectors.groupBy("term").agg(*[
        F.sum(F.when(F.col("aspect") == a, F.col("q"))).alias(f"q_{a}") for a in terms])
    weighted = (with_document_frequency(counts, dfreq, key)
                .withColumn("w", F.col("tf") * smooth_idf(n, F.col("df")))
                .join(F.broadcast(wide), "term", "left"))
    sums = weighted.groupBy(key).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
        *[F.sum(F.col("w") * F.col(f"q_{a}")).alias(f"_{a}") for a in terms])
    return sums.select(key, *[
        F.coalesce(F.col(f"_{a}") / F.col("_norm"), F.lit(0.0)).alias(f"relevance_{a}") for a in terms])


def _keyword_vectors(spark, terms: Mapping[str, Sequence[str]], stop_words: Sequence[str]) -> DataFrame:
    """``(aspect, term, qtf)`` of the keyword strings; as large as the dictionary."""
    strings = spark.createDataFrame([(a, " ".join(ts)) for a, ts in terms.items()],
                                    "aspect string, text string")
    return (term_counts(strings, "aspect", "text", stop_words=stop_words)
            .withColumnRenamed("tf", "qtf"))


def relevance_share_sentiment(df: DataFrame, overall: str, aspects: Sequence[str]) -> DataFrame:
    """Overall sentiment scaled by each aspect's share of the row's largest relevance."""
    rel = {a: F.col(f"relevance_{a}") for a in aspects}
    top = F.greatest(*rel.values()) if len(rel) > 1 else next(iter(rel.values()))
    return df.withColumns({
        f"{a}_sentiment_score": F.when(top > 0, F.col(overall) * (F.coalesce(r, F.lit(0.0)) / top))
        .otherwise(F.lit(0.0)) for a, r in rel.items()})


def language_profiles(labelled: DataFrame, text: str, lang: str, n: int = 3) -> DataFrame:
    """All character n-grams of each language with their shares; rows without a language are left out.

    Each task counts the n-grams of some million characters at a time; the counts are summed map-side again, so
    what moves is the set of distinct n-grams, which the alphabets bound, not the text.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(_padded(F.col(text)), F.lit("")).alias("_p"))
    schema = T.StructType([rows.schema["lang"], T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch.column(1)):
                mine = batch.slice(part[0], len(part))
                for x in mine.column(0).unique():
                    chosen = mine.filter(pc.equal(mine.column(0), x))
                    grams, counts = _grams_of(chosen.column(1).to_pylist(), n)
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(grams), mine.column(0).type), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], schema.names)

    counts = rows.mapInArrow(work, schema).groupBy("lang", "gram").agg(F.sum("tf").alias("c"))
    total = counts.groupBy("lang").agg(F.sum("c").alias("total"))
    return counts.join(F.broadcast(total), "lang").select("lang", "gram", (F.col("c") / F.col("total")).alias("share"))


def _steps(texts: pa.Array) -> list[np.ndarray]:
    """The places of neighbouring texts with about ``STEP_CHARS`` bytes together."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    return [p for p in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // STEP_CHARS)) + 1) if len(p)]


def _points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def _grams_of(texts: Sequence[str], n: int) -> tuple[list[str], np.ndarray]:
    """The n-grams of padded texts and how often each occurs. Between two words stand two blanks, between two texts too."""
    points = code = _points(texts)
    for k in range(1, n):
        if k > 2:  # three code points fill a number; longer beginnings are numbered
            code = np.unique(code, return_inverse=True)[1]
        code = code[:len(points) - k] << POINT_BITS | points[k:]
    between = np.r_[0, np.cumsum((points[:-1] == ord(" ")) & (points[1:] == ord(" ")))]
    at = np.flatnonzero(between[n - 1:] == between[:len(between) - n + 1]) if len(points) >= n else np.zeros(0, np.int64)
    _, first, counts = np.unique(code[at], return_index=True, return_counts=True)
    whole = points[at[first][:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le")
    return [whole[i:i + n] for i in range(0, len(whole), n)], counts


def _ngram_counts(text: Column, n: int) -> Column:
    """``[(term, tf)]`` of the letter n-grams of a text."""
    return F.transform(F.array(F.sort_array(_ngrams(text, n))), _run_lengths)[0]


def _padded(text: Column) -> Column:
    """The words of a text in lower case, each with one blank on either side; NULL without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.nullif(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), F.lit("  "))


def _ngrams(text: Column, n: int) -> Column:
    """Letter n-grams of each padded word; a look-ahead group reads the overlapping ones in one pass."""
    grams = F.regexp_extract_all(_padded(text), F.lit(f"(?=(.{{{n}}}))"), F.lit(1))
    return F.filter(grams, lambda g: ~g.contains("  "))


PROFILE_CELLS = 8_000_000  # shares, n-grams times languages, that every Python worker may hold
POINT_BITS = 21  # of a Unicode code point
STEP_CHARS = 1 << 20  # bytes of text scored at once; a longer single text is one step of its own


class _GramTable:
    """The n-grams of all profiles as sorted numbers, one table for each length of their beginnings.

    A beginning's number is the number of the beginning one character shorter and the last code point, packed,
    so n-grams of any length are told apart exactly.
    """

    def __init__(self, grams: Sequence[str], shares: np.ndarray, n: int):
        points = _points(grams).reshape(len(grams), n)
        self.tables, code = [], np.zeros(len(grams), np.int64)
        for k in range(n):
            known, code = np.unique(code << POINT_BITS | points[:, k], return_inverse=True)
            self.tables.append(known)
        self.shares = np.zeros((len(grams) + 1, shares.shape[1]))  # the last row is for unknown n-grams
        self.shares[code] = shares

    def sums(self, texts: Sequence[str]) -> np.ndarray:
        """For each padded text and language, the sum of the shares of its n-grams."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = _points(texts)
        code = np.zeros(len(points), np.int64)
        for k, known in enumerate(self.tables):
            wanted = code[:len(points) - k] << POINT_BITS | points[k:]
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            code = np.where((code[:len(wanted)] >= 0) & (known[at] == wanted), at, -1)
        of = np.repeat(np.arange(len(texts)), sizes)
        last = of[len(self.tables) - 1:]
        code = np.where(of[:len(code)] == last, code, -1)  # no n-gram reaches into the next text
        return np.stack([np.bincount(last, column[code], len(texts)) for column in self.shares.T], 1)


def language_tag(df: DataFrame, key: str, text: str, profiles: DataFrame, n: int = 3) -> DataFrame:
    """``(key, detected_lang, is_english)``; the profile with the largest summed share wins.

    ``profiles`` has a row for each language and n-gram (see ``language_profiles``); it is stored as one row per
    n-gram with the shares of all languages. Up to ``PROFILE_CELLS`` counted shares it is sent to every task, and
    each text is scored where it is read, so no text is shuffled. A larger one is joined: a text then sends each
    of its n-grams once, with the number of times it has it. ``key`` is unique. Text without any known n-gram is
    ``unknown``.
    """
    known = store(profiles.filter((F.length("gram") == n) & F.col("lang").isNotNull()), "profiles")
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not langs:
        return df.select(key, F.lit("unknown").alias("detected_lang"), F.lit(False).alias("is_english"))
    shares = [F.sum(F.when(F.col("lang") == x, F.col("share"))) for x in langs]
    wide = store(known.groupBy("gram").agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in shares]).alias("shares")), "profile-rows")
    limit = PROFILE_CELLS // len(langs)
    scored = _scored_in_task if wide.limit(limit + 1).count() <= limit else _scored_by_join
    sums = scored(df, key, text, wide, len(langs), n)
    best = F.array_max(F.array(*[F.struct(F.bround(F.col("sums")[i], 9).alias("s"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]))
    lang = F.when(best["s"] > 0, best["lang"])
    return sums.select(key, F.coalesce(lang, F.lit("unknown")).alias("detected_lang"),
                       F.coalesce(lang == "en", F.lit(False)).alias("is_english"))


def _scored_in_task(df: DataFrame, key: str, text: str, wide: DataFrame, langs: int, n: int) -> DataFrame:
    """``(key, sums)`` with the profiles in every task; texts are taken a megabyte at a time."""
    found = wide.toArrow()
    grams = found.column("gram").to_pylist()
    values = np.array(found.column("shares").to_pylist(), float).reshape(len(grams), langs)
    shared = df.sparkSession.sparkContext.broadcast((grams, values))
    rows = df.select(key, F.coalesce(_padded(F.col(text)), F.lit("")).alias("_p"))
    schema = T.StructType([rows.schema[key], T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _GramTable(*shared.value, n)
        for batch in batches:
            texts, sums = batch.column(1).to_pylist(), []
            for part in _steps(batch.column(1)):
                sums.append(table.sums([texts[i] for i in part]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * langs), pa.array(np.concatenate([np.zeros((0, langs)), *sums]).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema.names)

    return rows.mapInArrow(work, schema)


def _scored_by_join(df: DataFrame, key: str, text: str, wide: DataFrame, langs: int, n: int) -> DataFrame:
    """``(key, sums)`` by a join on the n-gram; sums are formed map-side."""
    grams = df.select(key, F.explode_outer(_ngram_counts(F.col(text), n)).alias("_g")).select(key, F.col("_g.term").alias("gram"), F.col("_g.tf").alias("tf"))
    hits = grams.join(wide, "gram", "left")
    return hits.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.col("tf") * F.col("shares")[i]), F.lit(0.0)) for i in range(langs)]).alias("sums"))


Scorer = Callable[[pd.Series], Iterable[tuple[str, float]]]


def spam_score(df: DataFrame, key: str, text: str, scorer: Scorer, batch: int = 256) -> DataFrame:
    """``(key, spam_label, spam_confidence)`` from a caller's classifier, in batches per task."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                labels, confidence = zip(*scorer(part[text]))
                yield pd.DataFrame({key: part[key].to_numpy(), "spam_label": labels,
                                    "spam_confidence": confidence})
    dtype = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(
        run, f"{key} {dtype}, spam_label string, spam_confidence double")


SPAM_WORDS = r"[\p{L}\p{N}_]+"


@dataclass(frozen=True)
class SpamModel:
    """Naive Bayes over words: ``terms`` has ``(term, n, weight)``, ``prior`` the log odds of spam."""

    terms: DataFrame
    prior: Column


def fit_spam_model(labelled: DataFrame, text: str, label: str) -> SpamModel:
    """Multinomial Naive Bayes of two classes with add-one smoothing, on every row with a label.

    Words are counted per class with map-side sums. A term's weight is the logarithm of its share
    in spam over its share in the rest. The counts are stored, because scoring reads them twice.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select((F.col(label) > 0).alias("_spam"), F.col(text).alias("_text"))
    words = rows.select("_spam", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(SPAM_WORDS), F.lit(0))).alias("term"))
    counts = materialize(words.groupBy("term").agg(F.count_if("_spam").alias("spam"), F.count_if(~F.col("_spam")).alias("ham")))
    total = counts.agg(F.struct(F.sum("spam").alias("spam"), F.sum("ham").alias("ham"), F.count("*").alias("terms")).alias("x")).scalar()

    def share(c: str) -> Column:
        return (F.col(c) + 1) / (total[c] + total["terms"])

    terms = counts.select("term", (F.col("spam") + F.col("ham")).alias("n"), (F.log(share("spam")) - F.log(share("ham"))).alias("weight"))
    odds = F.log((F.count_if("_spam") + 1) / (F.count_if(~F.col("_spam")) + 1))
    return SpamModel(terms, rows.agg(odds.alias("x")).scalar())


def spam_score_with_model(df: DataFrame, key: str, text: str, model: SpamModel) -> DataFrame:
    """``(key, spam_label, spam_confidence)``; words that no labelled row has say nothing."""
    counts = store(term_counts(df, key, text, SPAM_WORDS), "term-counts")
    found = with_term_value(counts, model.terms, key, "n", "weight")
    sums = found.groupBy(key).agg(F.coalesce(F.sum(F.col("tf") * F.col("weight")), F.lit(0.0)).alias("_s"))
    odds = sums.select(key, (F.col("_s") + model.prior).alias("_odds"))
    return odds.select(
        key, F.when(F.col("_odds") > 0, "spam").otherwise("ham").alias("spam_label"),
        S.half_even(1 / (1 + F.exp(-F.abs("_odds"))), 3).alias("spam_confidence"))


def token_budget(df: DataFrame, text: str, budget: int = dims.EVIDENCE_TOKEN_BUDGET,
                 out: str = "context") -> DataFrame:
    """Cut assembled evidence to the model's input budget, estimated at four characters a token."""
    chars = budget * dims.CHARS_PER_TOKEN
    tokens = F.ceil(F.length(text) / F.lit(dims.CHARS_PER_TOKEN)).cast("bigint")
    return df.withColumns({"estimated_tokens": tokens, out: F.substring(text, 1, chars)})


def reviews_per_side(budget: int = dims.EVIDENCE_TOKEN_BUDGET) -> int:
    """How many reviews of each company fit into half the budget."""
    return budget // 2 // dims.TOKENS_PER_REVIEW
