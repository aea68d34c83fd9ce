"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.session import cut_lineage, ensure_checkpoint_dir, ship_package

__all__ = ["bounded_rows", "bounded_sample", "cut_lineage", "ensure_checkpoint_dir", "fold_of", "free_name", "ship_package", "table",
           "text_blocks", "TextBlock"]

#: Bytes of text that one numpy pass handles at a time (a longer text is a block of its own).
BLOCK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares names without case)."""
    used = {c.lower() for c in taken}
    name = stem
    while name.lower() in used:
        name = f"_{name}"
    return name


def fold_of(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "utf-8")), F.lit(modulus)), F.lit(-1))


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest key hash: a top-n per task, then a merge. The
    choice depends on the keys alone, not on the partitioning."""
    return df.orderBy(F.xxhash64(key), F.col(key)).limit(n)


def bounded_rows(docs: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """``label, text`` of at most ``n`` rows per class: the rows of ``docs`` (doc_id, text) whose id is in ``sample`` (doc_id,
    label; bounded). Equal rows of an id count once. An id that repeats with other texts adds rows, so the bound is drawn again
    over (id, text), by their hash; where ids are unique nothing is dropped by that."""
    rows = cut_lineage(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("key")), "labelled")
    thin = rows.select("doc_id", "label", "key").distinct()
    order = [F.xxhash64("doc_id", "key"), F.col("doc_id"), F.col("key")]
    chosen = [thin.filter(F.col("label") == x).orderBy(*order).limit(n) for x in (0, 1)]
    kept = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), ["doc_id", "label", "key"], "left_semi")
    return kept.dropDuplicates(["doc_id", "label", "key"]).select("label", "text")


class TextBlock:
    """Consecutive texts of an Arrow batch as one byte buffer without copying.

    ``buf``: uint8 bytes; ``starts``/``ends``: byte offsets of each text in ``buf``; ``first``: index
    of the first text inside the batch. Null texts are empty.
    """

    __slots__ = ("buf", "starts", "ends", "first")

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.buf, self.starts, self.ends, self.first = buf, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    def text_bytes(self, i: int) -> bytes:
        return self.buf[self.starts[i]:self.ends[i]].tobytes()


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """Cut a string array into blocks of about ``limit`` bytes, whole texts each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        lo, hi = offsets[i], offsets[j]
        yield TextBlock(raw[lo:hi], offsets[i:j] - lo, offsets[i + 1:j + 1] - lo, i)
        i = j
