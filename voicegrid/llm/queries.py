"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid.llm.decontaminate import contamination
from voicegrid.llm.exact_dedup import exact_groups
from voicegrid.llm.line_dedup import without_repeated_lines
from voicegrid.llm.mixing import mixture, with_sizes
from voicegrid.llm.ngram_join import near_duplicates
from voicegrid.llm.packing import packed_documents
from voicegrid.llm.periodic_runs import periodic_runs, runs_text, strongest
from voicegrid.llm.piece_counts import piece_counts
from voicegrid.llm.prefix_trie import first_turns, prefix_trie, turn_digests
from voicegrid.llm.quality import score_quality
from voicegrid.llm.token_files import read_documents, with_checksums, write_token_files
from voicegrid.llm.tokens import default_tokenizer
from voicegrid.llm.toxicity import score_documents
from voicegrid.llm.warc import merge_index, read_archives, write_archives
from voicegrid.session import work_dir
from voicegrid.sources.reviews import read_table


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(read_table(spark, sf, "documents"), default_tokenizer(), capacity=4096, end_id=2)


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf, "documents"))


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "token-files")
    write_token_files(read_table(spark, sf, "documents"), path, default_tokenizer(), end_id=1)
    return with_checksums(read_documents(spark, path))


def op5_piece_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    return piece_counts(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out, lines, words = without_repeated_lines(read_table(spark, sf, "documents"))
    return out.select("doc_id", F.col(lines).alias("cut_lines"), F.col(words).alias("cut_words"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(read_table(spark, sf, "documents"), keep="max")


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "archives")
    # The table has no capture times, so each page gets one from its number.
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    runs = write_archives(read_table(spark, sf, "pages"), path, date)
    index = merge_index(runs, work_dir(spark, "index"))
    return read_archives(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs, size, quality = with_sizes(read_table(spark, sf, "documents"))
    mixed = mixture(docs, size_col=size, weight_col=quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts that ``op12`` reads: of every tenth document, by a hash of its id, the words from some word on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " "))

    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    # The words stand in an array of one, so that they are cut once and not at each mention.
    changed = F.element_at(F.transform(F.array(words), planted), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(changed, "text")).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found, runs, collapsed = periodic_runs(with_planted_runs(read_table(spark, sf, "documents").select("doc_id", "text")))
    found = found.withColumn("best", strongest(F.col(runs)))
    return found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(runs_text(F.col(runs)), 256).alias("runs_sha256"),
                        F.sha2(F.coalesce(collapsed, F.lit("")), 256).alias("collapsed_sha256"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = turn_digests(read_table(spark, sf, "conversations"))
    # Each conversation takes over the first turns of the first one of its hundred in place of its own.
    skip = F.crc32(F.col("conv").cast("string")) % 6
    heads = first_turns(turns.filter(F.col("conv") % 100 == 0), 5).select(F.col("conv").alias("from"), "head")
    convs = turns.select("conv").distinct().withColumns({"skip": skip.cast("int"), "from": F.col("conv") - F.col("conv") % 100})
    taken = convs.join(heads, "from", "left").withColumn("head", F.slice("head", F.lit(1), F.col("skip")))
    return prefix_trie(turns, taken.select("conv", "skip", "head"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_packing, op3_ngram_join, op4_token_files, op5_piece_counts, op6_line_dedup, op7_quality,
    op8_exact_dedup, op9_warc, op10_decontamination, op11_mixing, op12_periodic_runs, op13_prefix_trie, pipeline)}

# CRC-32 of a number's decimal text, bit by bit.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)")
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_ngram_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWERED.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
        CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (
  SELECT item_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)""",
    "op11_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS visible,
    length(regexp_replace(coalesce(text, ''), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS letters,
    (CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / ((greatest(letters, 1)::DOUBLE / greatest(visible, 1)) * (greatest(letters, 1)::DOUBLE / greatest(visible, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, 3 * source_size / weight AS stop FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN stop <= level THEN (3 * source_size)::DOUBLE
    ELSE weight * (SELECT arg_min(level, (stop, source IS NULL, source)) FROM l WHERE stop > level) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END AS epochs, floor(target + 0.5) AS budget FROM t),
p AS (SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key) - size AS before FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p""",
    "op12_periodic_runs": f"""
WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC.format("doc_id")} AS h FROM documents),
g AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
z AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM z),
f AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) > 5)),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
c AS (SELECT * FROM s WHERE length >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.q < c.q AND c.q % b.q = 0
    AND b.start <= c.start AND b.start + b.length >= c.start + c.length)),
v AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)),
x AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN v USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, start, q) AS place FROM r),
l AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS list FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.n, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
       sha256(coalesce(l.list, '')) AS runs_sha256, sha256(coalesce(x.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (doc_id)""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS part, i, r, x FROM c JOIN t ON t.conv_id = c.base AND i < h
  UNION ALL SELECT c.conv_id, 1, i, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h),
k AS (SELECT conv_id, 0 AS d, '' AS key, 0 AS size FROM c UNION ALL
  SELECT conv_id, row_number() OVER o, string_agg(md5(length(r) || ':' || r || x), ',') OVER o, length(x) FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY part, i)),
p AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM k),
n AS (SELECT key, any_value(parent) AS parent, min(d) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key),
y AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN y USING (key)),
s AS (SELECT a.key, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.size)::BIGINT AS saved_tokens
  FROM u JOIN p a ON a.conv_id = u.conv_id AND a.d <= u.depth GROUP BY a.key)
SELECT u.conv_id, u.depth, o.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, u.ends_sha256
FROM u JOIN s USING (key) LEFT JOIN n o ON o.key = u.parent AND u.depth > 0""",
}
