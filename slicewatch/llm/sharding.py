"""Contiguous shards of equal bytes by global prefix sums.

Rows are put in one total order; every partition adds up its own sizes, the partition totals give each partition its
offset, and offset plus local sum is the row's place in the corpus's byte line. The line is cut at equal targets,
so a shard is one contiguous range of the order and its size misses the target by one row at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, free_name
from slicewatch.llm.order import running_totals


@dataclass(frozen=True)
class Sharding:
    shards: int = 40
    row_bytes: int = 16         # added to every row's text bytes


def _by_id() -> list[Column]:
    """The order of the shards: ids, null first; then size, checksum and row."""
    return [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("row")]


def sizes(docs: DataFrame, p: Sharding = Sharding(), doc_id: str = "doc_id", text: str = "text",
          row: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, row``: thin rows, one per document; ``row`` tells rows apart."""
    raw = F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       (F.octet_length(raw) + p.row_bytes).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"))


def assign(thin: DataFrame, order: list[Column], p: Sharding = Sharding()) -> DataFrame:
    """``thin`` (written rows with a ``long`` column ``size``) with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, 2, ...
    inside the shard), both along ``order``.

    A row belongs to the target that holds its middle byte. Sums stay exact while twice the corpus's bytes
    times ``shards`` fit a 64-bit integer (10^17 bytes with 40 shards). A row larger than a target leaves
    the shards it spans empty. An empty table stays empty.
    """
    line = running_totals(thin, order)
    total = thin.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    middle = (F.col("start") * 2 + F.col("size")) * p.shards
    cut = F.call_function("div", middle, F.lit(max(2 * total, 1)).cast("long"))
    placed = line.withColumn("shard", F.least(cut.cast("int"), F.lit(p.shards - 1)))
    first = placed.groupBy("shard").agg(F.min("position").alias("first_position"))    # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(f"`{c}`") for c in thin.columns], "shard", (F.col("position") - F.col("first_position")).alias("slot"))


def shard(docs: DataFrame, p: Sharding = Sharding(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``, shards contiguous in doc_id.

    A null text counts its fixed bytes alone; null ids come first; rows of one id follow by size and
    checksum, and only rows alike in all three are interchangeable. Other columns are not read.
    """
    return assign(cut_lineage(sizes(docs, p, doc_id, text), "sizes"), _by_id(), p).drop("row")


def manifest(placed: DataFrame) -> DataFrame:
    """One row per shard that holds rows: ``shard, rows, bytes, first_id, last_id``."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"),
                                       F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def write_shards(docs: DataFrame, path: str, p: Sharding = Sharding(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole rows as Parquet, one folder per shard, files and rows in slot order, and return the
    manifest. Added columns are named ``shard`` and ``slot``, with underscores before where they clash."""
    keyed = cut_lineage(docs.withColumn(free_name(docs.columns, "row_key"), F.monotonically_increasing_id()), "rows")
    key, taken = keyed.columns[-1], list(keyed.columns)
    thin = cut_lineage(sizes(keyed, p, doc_id, text, key), "sizes")
    placed = cut_lineage(assign(thin, _by_id(), p), "placed")
    into, at = free_name(taken, "shard"), free_name(taken, "slot")
    same = free_name([*taken, into, at], "row_of")
    found = placed.select(F.col("row").alias(same), F.col("shard").alias(into), F.col("slot").alias(at))
    rows = keyed.join(found, F.col(key) == F.col(same)).drop(key, same)
    (rows.repartitionByRange(into, at).sortWithinPartitions(into, at)
     .write.mode("overwrite").partitionBy(into).parquet(path))
    return manifest(placed)
