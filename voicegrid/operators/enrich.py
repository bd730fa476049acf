"""Model enrichment as table-in, table-out steps around an injected text model."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voicegrid.schema import ISSUES

# Messages stored with defaulted results, and the reply formats.
NO_REVIEW = "No review provided"
NO_REASON = "No reasoning provided by AI."
MISSING_REPLY = "Missing AI response in batch"
CALL_FAILED = "AI API call failed"
NO_PRODUCT = "Not provided"
INVALID = "Invalid AI Response: "
UNPARSED = "AI response parsing error: Response from AI did not match expected format."
BAD_CONFIDENCE = "Confidence score is outside the 0-100 range."
BAD_SENTIMENT = "Sentiment score is outside the -100 to 100 range."
NOT_MENTIONED = ("n/a", "na", "none")
REVIEW_TAG = r"\[Review (\d+)\]"
SCORE, PRODUCT, REASON = r"Score:\s*(\d+)", r"Product:\s*([^\n]+)", r"Reason:\s*([^\n]+)"
ASPECT_SCORE = r"(?i)Score:\s*(-?\d+|N/A|NA)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _found(text: Column, pattern: str) -> Column:
    """First group of the first match, NULL without a match."""
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


# -- prompts -----------------------------------------------------------------------------------


def fill_template(template: str, columns: Mapping[str, Column]) -> Column:
    """``{name}`` placeholders of a template replaced by columns; NULL becomes empty text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if i % 2 else F.lit(p)
                      for i, p in enumerate(parts)])


def bullet_block(dim: DataFrame, line: Column, order: str, out: str = "block") -> DataFrame:
    """The rows of a small dictionary as one text of lines, in dictionary order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return dim.agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias(out))


def prompt_column(df: DataFrame, template: str, columns: Mapping[str, str],
                  blocks: DataFrame | None = None, out: str = "prompt") -> DataFrame:
    """Add a prompt per row. ``blocks`` is a one-row table of shared texts, read as scalars."""
    shared = {} if blocks is None else {c: blocks.select(c).scalar() for c in blocks.columns}
    values = {k: shared[v] if v in shared else F.col(v) for k, v in columns.items()}
    return df.withColumn(out, fill_template(template, values))


def batch_prompts(batched: DataFrame, text: str = "review") -> DataFrame:
    """One prompt body per batch: ``[Review i]: "text"`` lines in batch order."""
    line = F.format_string('[Review %d]: "%s"', F.col("index_in_batch"), F.coalesce(F.col(text), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.col("index_in_batch").alias("i"), line.alias("l"))))
    return batched.groupBy("batch").agg(
        F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("prompt"),
        F.count("*").alias("size"))


# -- the model call ----------------------------------------------------------------------------


def batch_infer(df: DataFrame, key: str, prompt: str, model: Callable[[str], str], retries: int = 3,
                delay: float = 0.0, calls_per_second: float | None = None, callers: int | None = None) -> DataFrame:
    """``(key, reply, error)`` from a text model, called within each task at least once per row.

    A failed call is tried again after a doubling delay; when all tries fail the row has no reply and
    names the error, so a bad row never fails the job. ``calls_per_second`` caps the whole job, tries
    included: prompts are dealt to ``callers`` tasks (at most one per second of the cap, 8 unless named) by a
    hash of their key, and each keeps to its share, so more executors do not mean more calls. Store the
    result before reading it more than once, or the model is asked again; ``stored_replies`` does that.
    """
    tries = max(1, retries)
    rows = df.select(key, prompt)
    gap = 0.0
    if calls_per_second:
        callers = callers or min(8, max(1, int(calls_per_second)))
        gap = callers / calls_per_second
    if callers:
        rows = rows.repartition(callers, F.col(key))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = 0.0  # when the next call may begin

        def ask(text: str) -> tuple[str | None, str | None]:
            nonlocal free
            last = ""
            for attempt in range(tries):
                if gap:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + gap
                try:
                    return model(text), None
                except Exception as error:  # the model is foreign code: any failure becomes a row
                    last = f"{type(error).__name__} - {error}"
                    if attempt + 1 < tries:
                        time.sleep(delay * 2 ** attempt)
            return None, last

        for pdf in parts:
            replies = [ask(text) for text in pdf[prompt]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "reply": pd.Series([r for r, _ in replies], dtype=object),
                                "error": pd.Series([e for _, e in replies], dtype=object)})

    dtype = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"{key} {dtype}, reply string, error string")


def stored_replies(df: DataFrame, key: str, prompt: str, model: Callable[[str], str], path: str, rounds: int = 1,
                   again: bool = False, **options) -> DataFrame:
    """The replies to all prompts of ``df``, kept as Parquet at ``path`` under their unique keys.

    Only keys that have no reply there are asked for, so a run that broke off goes on where it stopped, and
    a second run asks for nothing. The prompts are dealt to ``rounds``, each stored before the next begins: at
    most one round is asked twice. With ``again`` prompts whose call failed are asked once more, and their
    latest answer counts. ``options`` are those of ``batch_infer``.
    """
    spark = df.sparkSession
    dtype = df.schema[key].dataType.simpleString()
    kind = f"{key} {dtype}, reply string, error string, asked timestamp"

    def known() -> DataFrame:
        # An empty table first, so that there is always one to read.
        spark.createDataFrame([], kind).write.mode("append").parquet(path)
        return spark.read.schema(kind).parquet(path)

    for k in range(rounds):
        have = known()
        have = have.filter(F.col("error").isNull()) if again else have
        mine = df.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k) if rounds > 1 else df
        pending = mine.join(have.select(key).distinct(), key, "left_anti")
        batch_infer(pending, key, prompt, model, **options).withColumn("asked", F.current_timestamp()).write.mode("append").parquet(path)
    latest = known().groupBy(key).agg(F.max_by(F.struct("reply", "error"), F.struct(F.col("error").isNull(), "asked")).alias("_r"))
    return df.select(key).join(latest, key).select(key, "_r.reply", "_r.error")


# -- reading replies ---------------------------------------------------------------------------


def parse_single_reply(df: DataFrame, reply: str = "reply", product_optional: bool = False) -> DataFrame:
    """Raw ``raw_score``, ``raw_product`` and ``raw_reason``; all NULL unless all three occur.

    With ``product_optional`` a reply without a product line reads ``Not provided``.
    """
    parts = {"raw_score": SCORE, "raw_product": PRODUCT, "raw_reason": REASON}
    text = F.col(reply)
    whole = text.rlike(SCORE) & text.rlike(REASON)
    if not product_optional:
        whole = whole & text.rlike(PRODUCT)
    found = {n: F.when(whole, _found(text, p)) for n, p in parts.items()}
    if product_optional:
        found["raw_product"] = F.when(whole, F.coalesce(_found(text, PRODUCT), F.lit(NO_PRODUCT)))
    return df.withColumns(found)


def _review_blocks(df: DataFrame, keys: Sequence[str], size: str, reply: str) -> DataFrame:
    """``keys, pos, index_in_batch, body`` of every ``[Review n]`` block whose number is in the batch."""
    numbers = F.regexp_extract_all(reply, F.lit(REVIEW_TAG), F.lit(1))
    bodies = F.split(reply, r"\[Review \d+\]")
    bodies = F.slice(bodies, F.lit(2), F.size(bodies) - 1)
    blocks = df.select(*keys, size, F.posexplode(F.arrays_zip(numbers.alias("i"), bodies.alias("body"))))
    blocks = blocks.select(*keys, size, "pos", F.col("col.i").try_cast("int").alias("index_in_batch"),
                           F.col("col.body").alias("body"))
    return blocks.filter(F.col("index_in_batch").between(F.lit(1), F.col(size))).drop(size)


def parse_batch_reply(df: DataFrame, keys: Sequence[str], size: str = "size",
                      reply: str = "reply") -> DataFrame:
    """``[Review n]`` blocks to one row each; numbers outside the batch are ignored.

    Of two complete blocks with the same number the later one counts.
    """
    parsed = parse_single_reply(_review_blocks(df, keys, size, reply), "body")
    last = parsed.filter(F.col("raw_score").isNotNull()).groupBy(*keys, "index_in_batch").agg(
        F.max_by(F.struct("raw_score", "raw_product", "raw_reason"), "pos").alias("_r"))
    return last.select(*keys, "index_in_batch", "_r.*")


def parse_aspect_blocks(df: DataFrame, keys: Sequence[str], aspects: Sequence[str],
                        reply: str = "reply") -> DataFrame:
    """Nested ``Aspect / Score / Reason`` lines to ``(keys, aspect, raw_score, raw_reason)``."""
    blocks = df.select(*keys, F.posexplode(F.split(reply, "Aspect: ")).alias("pos", "_b"))
    lines = blocks.select(*keys, "pos", F.split(strip(F.col("_b")), "\n").alias("_l"))
    rows = lines.filter(F.size("_l") >= 3).select(
        *keys, "pos", strip(F.col("_l")[0]).alias("aspect"),
        _found(F.col("_l")[1], ASPECT_SCORE).alias("raw_score"),
        _found(F.col("_l")[2], REASON).alias("raw_reason"))
    rows = rows.filter(F.col("aspect").isin(list(aspects)) & F.col("raw_score").isNotNull()
                       & F.col("raw_reason").isNotNull())
    last = rows.groupBy(*keys, "aspect").agg(
        F.max_by(F.struct("raw_score", "raw_reason"), "pos").alias("_r"))
    return last.select(*keys, "aspect", "_r.*")


def parse_batch_aspect_reply(df: DataFrame, keys: Sequence[str], aspects: Sequence[str], size: str = "size",
                             reply: str = "reply") -> DataFrame:
    """``[Review n]`` blocks, each with aspect blocks, to ``(keys, index_in_batch, aspect, raw_score, raw_reason)``.

    Of two blocks with the same number only the later one counts, complete or not.
    """
    blocks = _review_blocks(df, keys, size, reply)
    last = blocks.groupBy(*keys, "index_in_batch").agg(F.max_by("body", "pos").alias("body"))
    return parse_aspect_blocks(last, [*keys, "index_in_batch"], aspects, "body")


def _reason(raw: Column) -> Column:
    return F.when(F.length(strip(F.coalesce(raw, F.lit("")))) > 0, raw).otherwise(NO_REASON)


def validate_classification(df: DataFrame, valid: Sequence[str], salvage: bool = True,
                            reply: str | None = None) -> DataFrame:
    """``score``, ``category`` and ``reason`` that are safe to store.

    A category outside the list is replaced by the first valid name it contains; without
    ``salvage``, or when it contains none, the row becomes (0, Unknown). Where the ``reply`` column
    is named, an empty one counts as a failed call.
    """
    number = F.col("raw_score").try_cast("bigint")
    names = F.array(*[F.lit(v) for v in valid])
    category = F.when(F.col("raw_product").isin(list(valid)), F.col("raw_product"))
    if salvage:
        inside = F.filter(names, lambda v: F.contains(F.col("raw_product"), v))
        category = F.coalesce(category, F.get(inside, F.lit(0)))
    failed = F.lit(False) if reply is None else is_blank(F.col(reply))
    problem = (F.when(failed, CALL_FAILED).when(number.isNull(), UNPARSED)
               .when(~number.between(0, 100), INVALID + BAD_CONFIDENCE)
               .when(category.isNull(), F.concat(F.lit(INVALID + "Category '"), F.col("raw_product"),
                                                 F.lit("' is not a valid option."))))
    checked = df.withColumns({"_problem": problem, "_category": category, "_score": number})
    ok = F.col("_problem").isNull()
    return checked.withColumns({
        "score": F.when(ok, F.col("_score").cast("int")).otherwise(0),
        "category": F.when(ok, F.col("_category")).otherwise("Unknown"),
        "reason": F.when(ok, _reason(F.col("raw_reason"))).otherwise(F.col("_problem")),
    }).drop("_problem", "_category", "_score", "raw_score", "raw_product", "raw_reason")


def validate_sentiment(df: DataFrame, aspect: str = "aspect") -> DataFrame:
    """``score`` in -100..100 and ``reason``; an aspect that is not mentioned scores 0."""
    number = F.col("raw_score").try_cast("bigint")
    absent = F.lower(strip(F.col("raw_score"))).isin(*NOT_MENTIONED)
    ok = number.between(-100, 100)
    return df.withColumns({
        "score": F.when(F.coalesce(~absent & ok, F.lit(False)), number.cast("int")).otherwise(0),
        "reason": F.when(absent, F.concat(F.lit("Aspect '"), F.col(aspect),
                                          F.lit("' was not mentioned in the review.")))
        .when(number.isNull(), UNPARSED).when(~ok, INVALID + BAD_SENTIMENT)
        .otherwise(_reason(F.col("raw_reason"))),
    }).drop("raw_score", "raw_reason")


def fill_missing_replies(grid: DataFrame, results: DataFrame, keys: Sequence[str],
                         defaults: Mapping[str, object], error: str | None = None,
                         reason: str = "reason") -> DataFrame:
    """Every cell of the batch grid, with defaults where the model gave nothing usable.

    ``error`` names a column of the grid that is set where the call for the cell's batch failed; there
    the default of ``reason`` says so.
    """
    marked = results.withColumn("_given", F.lit(True))
    out = grid.join(marked, list(keys), "left")
    filled = {c: F.when(F.col("_given"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}
    if error is not None:
        filled[reason] = F.when(F.col(error).isNotNull(), CALL_FAILED).otherwise(filled[reason])
    return out.withColumns(filled).drop("_given")


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def blank_review_passthrough(df: DataFrame, text: str,
                             enrich: Callable[[DataFrame], DataFrame],
                             scores: Sequence[str], reasons: Sequence[str]) -> DataFrame:
    """Enrich the reviews that have text; the others get NULL scores and a fixed reason."""
    done = enrich(df.filter(~is_blank(F.col(text))))
    types = {f.name: f.dataType for f in done.schema}
    blank = df.filter(is_blank(F.col(text))).withColumns({
        **{c: F.lit(None).cast(types[c]) for c in scores}, **{c: F.lit(NO_REVIEW) for c in reasons}})
    return done.unionByName(blank.select(*done.columns))


def pivot_aspect_results(long: DataFrame, keys: Sequence[str], aspects: Sequence[str]) -> DataFrame:
    """``(aspect, score, reason)`` rows to ``<Aspect>_Score`` and ``<Aspect>_Reasoning`` columns."""
    cells = []
    for a in aspects:
        here, name = F.col("aspect") == a, a.replace(" ", "_")
        cells += [F.max(F.when(here, F.col("score"))).alias(f"{name}_Score"),
                  F.max(F.when(here, F.col("reason"))).alias(f"{name}_Reasoning")]
    return long.groupBy(*keys).agg(*cells)


def explode_issue_json(df: DataFrame, keys: Sequence[str], reply: str = "reply") -> DataFrame:
    """One row per issue of a JSON reply, numbered from 1; missing texts are empty.

    A reply that is not valid JSON, or has no issues, gives no row.
    """
    parsed = df.select(*keys, F.posexplode(F.from_json(reply, ISSUES)["issues"]).alias("pos", "_i"))
    fields = [f.name for f in ISSUES["issues"].dataType.elementType]
    return parsed.select(*keys, (F.col("pos") + 1).alias("issue_no"),
                         *[F.coalesce(F.col(f"_i.{f}"), F.lit("")).alias(f) for f in fields])


def number_or_na(value: Column, places: int = 1) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.bround(value, places))).otherwise("N/A")


def insight_rows(df: DataFrame, primary_score: str, difference: str, analysis: str) -> DataFrame:
    """The stored comparison table; numbers that could not be computed read ``N/A``."""
    return df.select("competitor", "product", "aspect",
                     number_or_na(F.col(primary_score)).alias("sentiment_score"),
                     number_or_na(F.col(difference)).alias("sentiment_difference"), "year",
                     F.trim(analysis).alias("analysis"))
