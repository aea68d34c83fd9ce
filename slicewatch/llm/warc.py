"""WARC archives of pages, read back and indexed.

Records are written by Spark's text writer: the separator it puts after each row is the blank lines that
end a WARC record, so every part file is a gzip-compressed archive. Reading parses the archives by their
content lengths. The capture index is an external merge: every task sorts its captures into a run, runs
are cut by key ranges, and each range merges its pieces of all runs with a loser tree by URL key and time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, ensure_checkpoint_dir, ship_package


@dataclass(frozen=True)
class Archive:
    least_payload: int = 1000       # equal payloads of at least this many bytes are revisits
    file_bytes: int = 16 << 20      # payload bytes a file aims at
    crawl_start: str = "2024-01-01 00:00:00"  # capture time of page 0; each page id is a second later
    shard_rows: int = 100_000       # captures that one merge task orders


END = "\r\n\r\n"


def with_kinds(pages: DataFrame, p: Archive, page_id: str, url: str, html: str) -> DataFrame:
    """``page_id, url, html, bytes, digest, refers_to``: of equal payloads of at least ``least_payload`` bytes
    the largest page id is the response, others refer to it. Only repeated digests are joined, and the
    join is by digest, so a hot payload is split by AQE."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    repeated = (base.filter(F.col("bytes") >= p.least_payload).groupBy("digest")
                .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("digest", "top"))
    linked = base.join(cut_lineage(repeated, "payloads"), "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))
    return linked.withColumn("refers_to", F.when(F.col("top").isNotNull() & (F.col("bytes") >= p.least_payload) & other, F.col("top"))).drop("top")


def record_text(p: Archive) -> Column:
    """One WARC record without its end: a response with HTTP headers and payload, or a revisit with the
    HTTP headers alone. The payload's length and digest stand in both."""
    revisit = F.col("refers_to").isNotNull()
    # seconds since the epoch as digits, formatted without a session time zone
    second = F.coalesce(F.col("page_id"), F.lit(0)) % F.lit(1 << 32)
    date = F.date_format(F.expr(f"timestamp_ntz'{p.crawl_start}'") + F.make_dt_interval(secs=second.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                     F.col("bytes").cast("string"), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Date: "), date,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), target), F.lit("")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
                                 F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "))
    return F.concat(head, F.octet_length("block").cast("string"), F.lit(END), F.col("block")), block


def write_archives(pages: DataFrame, p: Archive = Archive(), page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write every page as a record; returns the folder (below the shared checkpoint folder). Files hold
    about ``file_bytes`` of payload; pages over 16 times the mean go to files counted by the largest."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    size = pages.select(F.octet_length(F.coalesce(F.col(html).cast("string"), F.lit(""))).alias("b")).agg(
        F.avg("b").alias("mean"), F.max("b").alias("top")).first()
    mean, top = max(float(size["mean"] or 0), 200.0), max(int(size["top"] or 0), 200)
    large = 16 * mean
    kinds = with_kinds(pages, p, page_id, url, html)
    text, block = record_text(p)
    for name, part, records in (("small", kinds.filter(F.col("bytes") <= large), p.file_bytes / mean),
                                ("large", kinds.filter(F.col("bytes") > large), p.file_bytes / top)):
        (part.withColumn("block", block).select(text.alias("value")).write.option("lineSep", END)
         .option("compression", "gzip").option("maxRecordsPerFile", max(1, int(records))).text(f"{folder}/{name}"))
    return folder


def _inflate(raw: bytes) -> bytes:
    out = []
    while raw:
        z = zlib.decompressobj(47)
        out.append(z.decompress(raw))
        out.append(z.flush())
        raw = z.unused_data
    return b"".join(out)


def _number(value: bytes) -> int | None:
    text = value.rsplit(b":", 1)[-1].rstrip(b">")
    return None if text == b"null" else int(text)


def parse(data: bytes):
    """The records of one archive: offset and length of the record, its headers and its content block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        yield at, end + 4 + size - at, head, data[end + 4:end + 4 + size]
        at = end + 8 + size


_FIELDS = (("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()),
           ("offset", pa.int64()), ("size", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()))
SCHEMA = ("url_key string, captured string, page_id long, archive string, offset long, size long, payload_bytes long, "
          "payload_digest string, record_type string, refers_to long")


def url_key(target: str) -> str:
    """Sort key of a URL: host labels in reverse order, then the rest (``org,example)/en``)."""
    _, sep, rest = target.partition("://")
    if not sep:
        return target
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return f"{','.join(reversed(rest[:end].lower().split('.')))}){rest[end:]}"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``. A response's payload is measured from its
    content; a revisit's from its headers."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, size, head, block in parse(_inflate(raw.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])
                    revisit = head[b"WARC-Type"] == b"revisit"
                    rows.append((
                        url_key(head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace")), head[b"WARC-Date"].decode(),
                        _number(head[b"WARC-Record-ID"]), path, offset, size,
                        int(fields[b"Content-Length"]) if revisit else len(payload),
                        head[b"WARC-Payload-Digest"].split(b":")[1].decode() if revisit else hashlib.sha1(payload).hexdigest(),
                        head[b"WARC-Type"].decode(), _number(head[b"WARC-Refers-To"]) if revisit else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)],
                                                 names=[n for n, _ in _FIELDS])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


class LoserTree:
    """Merge of sorted lists: inner nodes keep the loser of their match, the winner goes up, so each next
    row costs one match per level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.n = len(runs)
        self.loser = [-1] * max(self.n, 1)
        self.winner = self._play(1) if self.n > 1 else 0

    def _head(self, i: int):
        run = self.runs[i]
        return (0, run[self.at[i]], i) if self.at[i] < len(run) else (1, (), i)

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._head(b) < self._head(a):
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self):
        while self.n and self.at[self.winner] < len(self.runs[self.winner]):
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            node = (i + self.n) // 2
            while node:
                if self._head(self.loser[node]) < self._head(i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.winner = i


def merged_index(found: DataFrame, p: Archive = Archive()) -> DataFrame:
    """All captures in global order of URL key, time and page id: order by ``shard``, then ``position``. The key
    ranges include the page id, so one hot URL spreads over several shards."""
    key = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("offset")]
    runs = found.sortWithinPartitions(*key).withColumn("run_row", F.monotonically_increasing_id())
    runs = cut_lineage(runs, "runs")
    shards = max(1, -(-runs.count() // p.shard_rows), min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64))

    def run(batches):
        batches = [b for b in batches if b.num_rows]  # one key range: about shard_rows thin rows
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        order = np.argsort(table.column("run_row").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        run_of = table.column("run_row").to_numpy() >> 33  # the task that sorted it
        urls, times = table.column("url_key").to_pylist(), table.column("captured").to_pylist()
        ids = [-(1 << 63) if x is None else x for x in table.column("page_id").to_pylist()]
        cuts = np.flatnonzero(np.diff(run_of)) + 1
        pieces = [[(urls[i], times[i], ids[i], i) for i in part.tolist()] for part in np.split(np.arange(len(run_of)), cuts)]
        merged = table.take(pa.array([row[3] for row in LoserTree(pieces)], pa.int64())).drop_columns(["run_row"])
        merged = merged.append_column("position", pa.array(np.arange(len(run_of))))
        yield from merged.to_batches(max_chunksize=10_000)
    names = [n for n, _ in _FIELDS]
    ranged = runs.repartitionByRange(shards, *key).select(*names, "run_row")
    return ranged.mapInArrow(run, f"{SCHEMA}, position long").withColumn("shard", F.spark_partition_id())


def archive_pages(pages: DataFrame, p: Archive = Archive(), page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write, read back and index ``pages``: one capture row per page, in global order by (shard, position).

    Null html is an empty payload; a null url has an empty key; rows with a null id are archived under
    "null" and refer to the largest id among equal payloads. Rows that repeat the largest id are all
    responses. Long payloads stand whole in their record. An empty table gives an empty index. Other
    columns are not read.
    """
    folder = write_archives(pages, p, page_id, url, html)
    return merged_index(captures(pages.sparkSession, folder), p)
