"""Web archives: WARC files with revisit records, and one capture index merged from the files' sorted runs.

Each task writes its own archives and a run of captures for each, sorted by URL key and time. Ranges of the
index are then merged from all runs with a loser tree, so that reading the ranges in order gives the captures
of every URL in order of time. Records are read back through that index.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from voicegrid.llm.common import lookup, steps, stored

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 4 << 20
CAPTURES_PER_RANGE = 250_000
ROWS_AT_ONCE = 64
_KNOWN, _UNNUMBERED = 0x766F6963_65677269, 0x766F6963_65677200  # upper halves of record ids

INDEX = "urlkey string, timestamp string, page_id bigint, file string, offset bigint, length bigint"
RUN_SCHEMA = INDEX + ", run string"


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query, in lower case and without scheme, ``www.`` and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + query


def record_id(page_id: int | None, salt: int = 0) -> str:
    """The URN of a page's record; the page's number can be read from it."""
    upper, lower = (_UNNUMBERED, salt) if page_id is None else (_KNOWN, page_id)
    return f"<urn:uuid:{uuid.UUID(int=(upper << 64) | (lower & (1 << 64) - 1))}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (1 << 64) - 1
    return None if value >> 64 == _UNNUMBERED else low - (1 << 64) * (low >> 63)


def warc_record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str,
                first: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit carries the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, int(digest[:15], 16))}", f"WARC-Date: {date}",
            *([f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}"] if url else []), f"WARC-Payload-Digest: sha256:{digest}",
            *([f"WARC-Refers-To: {record_id(first)}",
               "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields in lower case, the payload, and the payload's length as the HTTP header states it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)content-length: *(\d+)", http)
    return fields, payload, int(stated[1]) if stated else len(payload)


class LoserTree:
    """K-way merge of sorted runs, read as iterators: each inner node keeps the loser of its match, the winner goes on."""

    def __init__(self, runs: Iterable[Iterable], key: Callable):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.rows = [next(r, None) for r in self.runs]
        self.heads = [None if row is None else key(row) for row in self.rows]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                if building:
                    self.losers[node] = winner
                    return
            elif self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.rows[w]
            row = self.rows[w] = next(self.runs[w], None)
            self.heads[w] = None if row is None else self.key(row)
            self._replay(w)


def capture_order(row: dict) -> tuple:
    """By URL key, time and page (null last); the place in the archives makes the order total."""
    return row["urlkey"], row["timestamp"] or "", row["page_id"] is None, row["page_id"] or 0, row["file"], row["offset"]


def write_archives(pages: DataFrame, path: str, date: Column, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write a record per row below ``path``, a folder that all executors share; returns the sorted runs, stored.

    Of records with equal payloads of at least ``LEAST_PAYLOAD`` bytes those of the smallest page are
    responses (null ids come last; repeated rows of that page are responses too), the others revisit it.
    Null html is an empty payload, a null URL leaves its field out. Each archive has a name of its own, so a
    repeated task writes another file, and only files of finished tasks are in the runs.
    """
    digest = F.sha2(F.coalesce(html_col, F.lit("")), 256)
    size = F.coalesce(F.octet_length(html_col), F.lit(0))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), date.cast("string").alias("date"),
                        F.coalesce(html_col, F.lit("")).alias("html"), digest.alias("digest"), size.alias("size"))
    groups = (rows.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
              .filter("copies > 1 AND first IS NOT NULL"))
    groups = stored(groups, "payloads")
    found = lookup(rows, groups, ["digest"], "copies")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    marked = found.select("page_id", "url", "date", "html", "digest", "first", revisit.alias("revisit"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(path)
        out, name, at, run = None, "", 0, []

        def finish() -> pa.RecordBatch:
            out.close()
            run.sort(key=capture_order)
            return pa.RecordBatch.from_pylist([r | {"run": name} for r in run], runs_schema)

        store.create_dir(root, recursive=True)
        for batch in batches:
            for part in steps(batch, "html"):
                for r in part.to_pylist():
                    if out is None:
                        name, at, run = f"captures-{uuid.uuid4().hex}.warc.gz", 0, []
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    record = warc_record(r["page_id"], r["url"], r["date"], r["html"].encode(), r["digest"], r["first"], r["revisit"])
                    press = zlib.compressobj(4, zlib.DEFLATED, 31)
                    packed = press.compress(record) + press.flush()
                    out.write(packed)
                    run.append({"urlkey": url_key(r["url"]), "timestamp": r["date"], "page_id": r["page_id"], "file": name,
                                "offset": at, "length": len(packed)})
                    at += len(packed)
                    if at >= ARCHIVE_BYTES:
                        yield finish()
                        out = None
        if out is not None:
            yield finish()

    names = {"string": pa.string(), "bigint": pa.int64()}
    runs_schema = pa.schema([(c.split()[0], names[c.split()[1]]) for c in RUN_SCHEMA.split(", ")])
    return stored(marked.mapInArrow(work, RUN_SCHEMA), "runs")


def _run_slices(batches: Iterable[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The rows of each run, as slices of the batches; batches are sorted by run."""
    kept: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        names = batch.column("run").to_pylist()
        begin = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[begin]:
                kept.setdefault(names[begin], []).append(batch.slice(begin, k - begin))
                begin = k
    return list(kept.values())


def _captures(slices: list[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of one run, some at a time."""
    for batch in slices:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from batch.slice(k, ROWS_AT_ONCE).to_pylist()


def merge_index(runs: DataFrame, path: str) -> DataFrame:
    """Merge sorted runs into one index at ``path``: Parquet files that follow each other in the order of
    ``capture_order``.

    The number of ranges follows from the number of captures, some ``CAPTURES_PER_RANGE`` each. They are cut by
    the whole order, so a URL with very many captures is spread over several of them. Spark brings each range's
    part of every run in order (its sort spills to disk); a task keeps these parts in columns, and the loser tree
    reads them as iterators, so that of each run only some rows are taken apart at a time.
    """
    spark = runs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // CAPTURES_PER_RANGE))
    schema = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in INDEX.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = []
        for row in LoserTree([_captures(s) for s in _run_slices(batches)], capture_order):
            merged.append(row)
            if len(merged) == 10_000:
                yield pa.RecordBatch.from_pylist(merged, schema)
                merged = []
        if merged:
            yield pa.RecordBatch.from_pylist(merged, schema)

    order = ["urlkey", F.coalesce("timestamp", F.lit("")), F.col("page_id").asc_nulls_last(), "file", "offset"]
    ranges = runs.repartitionByRange(parts, *order).sortWithinPartitions("run", *order)
    ranges.mapInArrow(work, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read_archives(index: DataFrame, path: str) -> DataFrame:
    """``page_id, urlkey, timestamp, payload_bytes, payload_digest, record_type, refers_to`` of every capture in the index.

    Captures are dealt out by pieces of archives and read in order of their place; length and digest of a
    response are computed from the payload that was read.
    """
    schema = ("page_id bigint, urlkey string, timestamp string, payload_bytes bigint, payload_digest string, "
              "record_type string, refers_to bigint")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.floor(F.col("offset") / (4 * READ_BYTES))

    def records(entries: list[dict]) -> Iterator[tuple]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(path)
        held, begin, source, name = b"", 0, None, None
        for e in entries:
            if e["file"] != name:
                name, held = e["file"], b""
                source = store.open_input_file(f"{root}/{name}")
            if not begin <= e["offset"] or e["offset"] + e["length"] > begin + len(held):
                begin = e["offset"]
                held = source.read_at(max(READ_BYTES, e["length"]), begin)
            raw = zlib.decompress(held[e["offset"] - begin:e["offset"] - begin + e["length"]], 31)
            fields, payload, stated = parse_record(raw)
            digest = fields["warc-payload-digest"].removeprefix("sha256:")
            revisit = fields["warc-type"] == "revisit"
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
            yield (page_of(fields["warc-record-id"]), e["urlkey"], fields["warc-date"], stated if revisit else len(payload),
                   digest, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            found = list(zip(*records(batch.to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types, strict=True)],
                                             [c.split()[0] for c in schema.split(", ")])

    wanted = index.select("urlkey", "file", "offset", "length")
    return (wanted.repartition(parts, "file", piece).sortWithinPartitions("file", "offset").mapInArrow(work, schema))


