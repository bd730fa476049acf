"""Corpus jobs against hand calculation and plain-Python brute force."""

import collections
import hashlib
import math
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from voicegrid import dims
from voicegrid.functions import words as W
from voicegrid.operators import lexicon as X, stem as P, textjobs as T


def reviews(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, review string")


TEXTS = ["the bill and the meter", "a bill", "meter meter reading", "", None, "nothing here at all", "bill bill meter the"]


def brute_tfidf(texts, pattern, vocabulary=None, stop=()):
    docs = [Counter(w for w in re.findall(pattern, (t or "").lower())
                    if w not in stop and (vocabulary is None or w in vocabulary)) for t in texts]
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log((1 + len(texts)) / (1 + c)) + 1 for w, c in df.items()}
    out = []
    for d in docs:
        v = {w: c * idf[w] for w, c in d.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        out.append({w: x / norm for w, x in v.items()})
    return out, idf


def test_topic_tfidf_equals_brute_force(spark):
    terms = {"a": ["bill", "smart meter"], "b": ["meter", "reading"]}
    got = {r.id: r for r in T.tfidf_topic_score(reviews(spark, TEXTS), "id", "review", terms).collect()}
    want, _ = brute_tfidf(TEXTS, r"\w\w+", {"bill", "meter", "reading"})
    assert len(got) == len(TEXTS)
    for i, v in enumerate(want):
        assert got[i].tfidf_a == pytest.approx(round(v.get("bill", 0), 3), abs=1e-9)
        assert got[i].tfidf_b == pytest.approx(round(v.get("meter", 0) + v.get("reading", 0), 3), abs=1.1e-3)


@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_aspect_cosine_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(T.with_document_frequency, "__defaults__", (hot,))
    terms = {"money": ["bill", "unpaid bill"], "kit": ["meter", "reading", "absent"]}
    got = {r.id: r for r in T.tfidf_aspect_cosine(reviews(spark, TEXTS), "id", "review", terms, ["the"]).collect()}
    vectors, idf = brute_tfidf(TEXTS, r"\w\w+", stop={"the"})
    for name, words in terms.items():
        q = Counter(w for w in re.findall(r"\w\w+", " ".join(words)) if w in idf)
        weights = {w: c * idf[w] for w, c in q.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        for i, v in enumerate(vectors):
            cosine = sum(v.get(w, 0) * x for w, x in weights.items()) / norm
            assert got[i][f"relevance_{name}"] == pytest.approx(cosine, abs=1e-12)
    assert len(got) == len(TEXTS)


def test_token_set_and_relevance(spark):
    df = T.token_set(reviews(spark, ["Late, late no-show 2nd", None]), "review")
    assert [sorted(r.tokens) for r in df.orderBy("id").collect()] == [["late", "no", "show"], []]
    out = T.aspect_relevance(df, "tokens", {"x": ["late", "no-show", "direct debit", "show"]}).orderBy("id")
    assert [r.relevance_x for r in out.collect()] == [2, 0]


def compound(spark, text):
    df = reviews(spark, [text])
    return X.lexicon_compound(df, "id", "review", dims.lexicon_dim(spark)).first().compound


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize("text,total", [
    ("good", 1.9), ("very good", 1.9 + 0.293), ("very much good", 1.9 + 0.293 * 0.95),
    ("very much so good", 1.9 + 0.293 * 0.9), ("not good", 1.9 * -0.74), ("not a very good", (1.9 + 0.293) * -0.74),
    ("not that it is good", 1.9), ("slightly bad", -2.5 + 0.293), ("it was GOOD", 1.9 + 0.733), ("GOOD", 1.9),
    ("good!!", 1.9 + 0.584), ("bad!!!!!!", -2.5 - 4 * 0.292), ("good?", 1.9), ("good??", 1.9 + 0.36),
    ("good????", 1.9 + 0.96), ("good but bad", 1.9 * 0.5 - 2.5 * 1.5), ("Great, (helpful).", 3.1 + 1.8),
    ("a great VERY good", 3.1 + 1.9 + 0.293 + 0.733),
])
def test_lexicon_rules(spark, text, total):
    assert compound(spark, text) == pytest.approx(norm(total), abs=1e-4)


@pytest.mark.parametrize("text", ["", None, "nothing known here!", "   "])
def test_text_without_lexicon_words_scores_zero(spark, text):
    assert compound(spark, text) == 0.0


def test_polarity(spark):
    df = reviews(spark, ["good bad", "none", None])
    got = [r.polarity for r in X.lexicon_polarity(df, "id", "review", dims.lexicon_dim(spark)).orderBy("id").collect()]
    assert got == [-0.3, 0.0, 0.0]


@pytest.mark.parametrize("text,total", [
    ("never so good", 1.9 * 1.25), ("never was so good", 1.9 * 1.25), ("never good", 1.9 * -0.74), ("least good", 1.9 * -0.74),
    ("at least good", 1.9), ("very least good", 1.9 + 0.293 * 0.95), ("kind of good", 1.9 - 0.293), ("sort of a good", 1.9 - 0.293),
    ("a great deal of love here", 3.1 + 3.2 + 0.293), ("love to hate", -2.0), ("very great pains", -1.5)])
def test_phrases(spark, text, total):
    assert compound(spark, text) == pytest.approx(norm(total), abs=1e-4)


def test_scoped_sentiment_reads_only_the_aspects_sentences(spark):
    df = reviews(spark, ["The engineer was great. The bill was awful! Bad day.", "All good."])
    terms = {"staff": ["engineer"], "money": ["bill"]}
    got = {(r.id, r.aspect): r.sentiment for r in X.sentence_scoped_sentiment(
        df, "id", "review", terms, dims.lexicon_dim(spark)).collect()}
    assert got == {(0, "staff"): norm(3.1), (0, "money"): norm(-2.0 - 0.292), (1, "staff"): None, (1, "money"): None}


def test_a_stem_begins_like_its_word(spark):
    words = """happy ponies hoping hopped agreed relational conditional rational valency hesitancy digitizer conformably radically
        differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality
        sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference
        airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate
        angularity homologous effective bowdlerize probate rate cease controlling rolling skies dying cabbability y by""".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    table = P.stem_vocabulary(docs.unionByName(spark.createDataFrame([(" ".join(words),)], "text string")), "text")
    assert table.filter("NOT startswith(word, left(stem, greatest(length(stem) - 1, 1)))").count() == 0
    assert table.count() > 5000


def test_scoped_sentiment_matches_by_stem(spark):
    df = reviews(spark, ["Billing was awful. The engineers were great!", "They billed us. Good.", None, "no-show"])
    terms = {"staff": ["engineer"], "money": ["bills"], "late": ["no-show", "late arrival"]}
    got = {(r.id, r.aspect): (r.sentiment, r.digest) for r in X.sentence_scoped_sentiment(
        df, "id", "review", terms, dims.lexicon_dim(spark)).collect()}
    assert len(got) == 12 and got[1, "money"][0] == 0.0 and got[1, "money"][1] == hashlib.md5(b"They billed us.").hexdigest()
    assert got[0, "money"][0] == norm(-2.0) and got[0, "staff"][0] == norm(3.1 + 0.292)
    assert {k for k, v in got.items() if v == (None, None)} == set(got) - {(0, "money"), (0, "staff"), (1, "money")}


def test_lexicon_job_shuffles_once_and_sorts_nothing(spark):
    df = reviews(spark, ["good"] * 3)
    plan = X.lexicon_compound(df, "id", "review", dims.lexicon_dim(spark))._jdf.queryExecution().executedPlan().toString()
    initial = plan
    assert initial.count("Exchange hashpartitioning(id") == 1
    assert "Window" not in initial and "SortMergeJoin" not in initial and "Python" not in initial


# Word pairs published with the algorithm (Porter 1980).
STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
         "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
         "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
         "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
         "valenci": "valenc", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper",
         "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
         "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
         "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
         "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
         "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
         "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler",
         "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is"}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], ["w"])
    assert {r.w: r.stem for r in P.stem_words(df, "w").collect()} == STEMS


def test_stemmed_relevance(spark):
    df = reviews(spark, ["Bills and billing, billed readings", "unrelated"])
    keys = dims.keyword_dim(spark, {"money": ["bill", "payment"], "kit": ["reading", "direct debit"]})
    got = {(r.id, r.aspect): r.relevance for r in P.stemmed_relevance(df, "id", "review", keys).collect()}
    assert got == {(0, "money"): 1, (0, "kit"): 1}


def test_language_tag(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tags = T.language_tag(df, "doc_id", "text", T.language_profiles(df, "text", "lang"))
    both = tags.join(df.select("doc_id", "lang"), "doc_id")
    right = both.filter(F.col("lang") == F.col("detected_lang")).count()
    assert right / df.count() > 0.9
    none = reviews(spark, ["123 !!", None, ""])
    out = T.language_tag(none, "id", "review", T.language_profiles(df, "text", "lang")).collect()
    assert {(r.detected_lang, r.is_english) for r in out} == {("unknown", False)}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_language_profiles_and_tags_by_brute_force(spark, monkeypatch, n):
    texts = [("en", "The cat, the hat! a"), ("en", "that 𝒜bc 日本語日本語"), ("fr", "le chat, l'été là-bas"), ("fr", None), (None, "x y z the"), ("de", "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, lang string, review string").repartition(2)

    def grams(text):
        words = regex.findall(r"\p{L}+", (text or "").lower())
        return [w[i:i + n] for w in (f" {x} " for x in words) for i in range(len(w) - n + 1)]

    counts = collections.defaultdict(collections.Counter)
    for lang, text in texts:
        if lang:
            counts[lang].update(grams(text))
    want = {(lang, g): c / sum(cs.values()) for lang, cs in counts.items() for g, c in cs.items()}
    profiles = T.language_profiles(df, "review", "lang", n)
    assert {(r.lang, r.gram): r.share for r in profiles.collect()} == want

    def tag(text):
        sums = {lang: round(sum(want.get((lang, g), 0) for g in grams(text)), 9) for lang in ("en", "fr")}
        best = max(sums, key=lambda lang: (sums[lang], lang))
        return best if sums[best] > 0 else "unknown"

    monkeypatch.setattr(T, "STEP_CHARS", 16)
    in_task = {r.id: r.detected_lang for r in T.language_tag(df, "id", "review", profiles, n).collect()}
    assert in_task == {i: tag(t) for i, (_, t) in enumerate(texts)}
    monkeypatch.setattr(T, "PROFILE_CELLS", 0)
    assert {r.id: r.detected_lang for r in T.language_tag(df, "id", "review", profiles, n).collect()} == in_task


def test_language_tag_of_empty_tables(spark):
    df = spark.createDataFrame([], "id int, lang string, review string")
    profiles = T.language_profiles(df, "review", "lang")
    assert T.language_tag(df, "id", "review", profiles).collect() == []
    assert T.language_tag(reviews(spark, ["some words"]), "id", "review", profiles).first().detected_lang == "unknown"


def test_spam_scorer_is_pluggable(spark):
    df = reviews(spark, ["win money", "hello", "win again"] * 5)
    scorer = lambda texts: [("spam", 0.95) if "win" in t else ("ham", 0.8) for t in texts]
    out = T.spam_score(df, "id", "review", scorer, batch=4)
    assert out.groupBy("spam_label").count().orderBy("spam_label").collect() == [("ham", 5), ("spam", 10)]


def test_spam_model_learns(spark):
    train = spark.createDataFrame([("win free money now", 1), ("claim your prize money", 1), ("my engineer was late", 0),
                                   ("good service and bill", 0)] * 5, "review string, label int")
    model = T.fit_spam_model(train, "review", "label")
    out = T.spam_score_with_model(reviews(spark, ["free prize money", "late engineer service"]), "id", "review", model)
    assert [r.spam_label for r in out.orderBy("id").collect()] == ["spam", "ham"]


def test_token_budget(spark):
    df = reviews(spark, ["x" * 100, "x" * 9])
    out = T.token_budget(df, "review", 20).orderBy("id").collect()
    assert [(len(r.context), r.estimated_tokens) for r in out] == [(80, 25), (9, 3)]
    assert T.reviews_per_side() == 80


def test_sentences_keep_digits_and_drop_blanks(spark):
    df = spark.createDataFrame([("00 bill was 100. 1 engineer came 11",), (" one.\n\t two!  ",), ("   ",), (None,)], "t string")
    got = [r[0] for r in df.select(W.sentences(F.col("t"))).collect()]
    assert got[0] == ["00 bill was 100.", "1 engineer came 11"]
    assert got[1] == ["one.", "two!"] and not got[2] and not got[3]


def test_row_values_are_rounded_as_they_are(spark):
    from voicegrid.functions import scores as S
    df = spark.createDataFrame([(0.545,), (0.575,)], "c double")
    assert [r[0] for r in df.select(S.rescale_100_int(F.col("c"))).collect()] == [55, 57]
