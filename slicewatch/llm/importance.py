"""Importance resampling towards a target distribution, over distinct lines.

Hashed n-gram counts of the corpus and of the target give every feature bucket a gain (log ratio of the smoothed
shares). A document's weight is its mean gain, its score the weight plus Gumbel noise from a hash of its
id, and the highest scores are drawn.

The corpus counts are taken by segment: newlines cut the texts into lines, equal lines collapse into one row with
its number of occurrences (partial counts per task, then one shuffle), each distinct line's n-grams are
counted once and multiplied by the occurrences. n-grams whose words lie in more than one line are added by
a pass of their own; with single words there are none and the pass is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, ship_package, text_blocks
from slicewatch.llm.crc import crc32_byte, crc32_spans
from slicewatch.llm.order import running_totals
from slicewatch.llm.words import ALNUM, spans


@dataclass(frozen=True)
class Resampling:
    min_n: int = 1              # features are all runs of min_n to max_n consecutive words
    max_n: int = 1
    buckets: int = 10_000       # the counts, the gains and the model have this size
    seed: str = "2024"
    min_words: int = 20         # shorter documents are not drawn
    draw: int = 10              # drawn share: draw / of, rounded down
    of: int = 100
    score_step: int = 64        # scores per bar of the histogram that finds the cut


def _features(buf, starts, ends, doc, p: Resampling):
    """(first word, last word, bucket) of every n-gram, one n at a time."""
    crc = crc32_spans(buf, starts, ends)
    for n in range(1, p.max_n + 1):
        if n > 1:
            keep = len(crc) - 1
            if keep <= 0:
                return
            crc = crc32_spans(buf, starts[n - 1:], ends[n - 1:], crc32_byte(0x20, crc[:keep]))
        if n >= p.min_n:
            first = np.flatnonzero(doc[:len(crc)] == doc[n - 1:])
            yield first, first + n - 1, (crc[first] % np.uint32(p.buckets)).astype(np.int64)


def _emit(counts: np.ndarray):
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def _count_lines(p: Resampling):
    def run(batches):
        counts = np.zeros(p.buckets, np.int64)
        for batch in batches:
            times = batch.column(1).to_numpy()
            for block in text_blocks(batch.column(0)):
                buf, starts, ends, doc = spans(block, ALNUM)
                for first, _, bucket in _features(buf, starts, ends, doc, p):
                    np.add.at(counts, bucket, times[block.first + doc[first]])
        yield from _emit(counts)
    return run


def _count_across(p: Resampling):
    def run(batches):
        counts = np.zeros(p.buckets, np.int64)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                buf, starts, ends, doc = spans(block, ALNUM)
                line = np.searchsorted(np.flatnonzero(buf == 0x0A), starts)
                for first, last, bucket in _features(buf, starts, ends, doc, p):
                    counts += np.bincount(bucket[line[first] != line[last]], minlength=p.buckets)
        yield from _emit(counts)
    return run


def distinct_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """``line, times``: every different line (A-Z lower-cased) and how often it occurs in all texts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lines = texts.select(F.explode(F.split(F.translate(F.col(text), upper, lower), "\n")).alias("line"))
    return lines.filter("line <> ''").groupBy("line").agg(F.count("*").alias("times"))


def bucket_counts(texts: DataFrame, p: Resampling = Resampling(), text: str = "text") -> DataFrame:
    """``bucket, n``: how often the features of all texts fall into each bucket (empty buckets are left out)."""
    ship_package(texts.sparkSession)
    found = distinct_lines(texts, text).mapInArrow(_count_lines(p), "bucket long, n long")
    if p.max_n > 1:
        across = texts.select(F.col(text).alias("text")).mapInArrow(_count_across(p), "bucket long, n long")
        found = found.unionByName(across)
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> np.ndarray:
    """Gain of every bucket: floor(1000 * ln of the ratio of add-one shares). At most ``buckets`` rows of
    each side reach the driver."""
    def counts(df: DataFrame) -> list[int]:
        out = [0] * p.buckets
        for bucket, n in df.collect():
            out[bucket] = n
        return out
    s, t = counts(corpus), counts(target)
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (all_s + p.buckets)) / float((a + 1) * (all_t + p.buckets))))
                     for a, b in zip(s, t)], np.int64)


def _weigh(gain: np.ndarray, p: Resampling):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            n_words, n_features, total = (np.zeros(n, np.int64) for _ in range(3))
            for block in text_blocks(batch.column(1)):
                buf, starts, ends, doc = spans(block, ALNUM)
                at = slice(block.first, block.first + len(block))
                n_words[at] = np.bincount(doc, minlength=len(block))
                for first, _, bucket in _features(buf, starts, ends, doc, p):
                    n_features[at] += np.bincount(doc[first], minlength=len(block))
                    np.add.at(total, block.first + doc[first], gain[bucket])
            weight = total // np.maximum(n_features, 1)      # floors go down
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (n_words, n_features, weight))],
                names=["doc_id", "n_words", "n_features", "weight"])
    return run


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths from the id alone; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, p: Resampling = Resampling(), doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row, by the given gains."""
    ship_package(docs.sparkSession)
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _weigh(gain, p), "doc_id long, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), p.seed))


def _cut(may: DataFrame, p: Resampling) -> tuple[int, int | None]:
    """(number to draw, a score that no drawn row lies under). A score is a logarithm of 64-bit counts plus
    noise of 32 bits, so the histogram has a few thousand bars at any size."""
    bars = sorted(((b, n) for b, n in may.groupBy(F.floor(F.col("score") / p.score_step).alias("bar")).count().collect()),
                  reverse=True)
    k = sum(n for _, n in bars) * p.draw // p.of
    seen = 0
    for bar, n in bars:
        seen += n
        if seen >= k:
            return k, bar * p.score_step
    return k, None


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling(), doc_id: str = "doc_id",
             text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_features, weight, score, rank`` (1, 2, 3, ... for the drawn
    rows by falling score and rising id, else null).

    Null, empty and word-less texts have no features and weight 0. Rows without an id get no score and are not
    drawn. Rows that repeat an id share its noise and are drawn each by itself; rows alike in score and id
    follow by features and weight, so only wholly alike rows are interchangeable. Empty tables give no rows
    (documents) or counts of zero (target). Other columns are not read.
    """
    gain = gains(bucket_counts(docs, p, text), bucket_counts(target, p, target_text), p)
    scored = cut_lineage(weigh(docs, gain, p, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "scored")
    may = (F.col("n_words") >= p.min_words) & F.col("score").isNotNull()
    k, low = _cut(scored.filter(may), p)
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, no_rank)
    near = may & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight"), F.col("row")]
    ranked = running_totals(scored.filter(near).withColumn("size", F.lit(1).cast("long")), order)
    place = F.col("position") + 1
    return (ranked.select(*out, F.when(place <= k, place).alias("rank"))
            .unionByName(scored.filter(~F.coalesce(near, F.lit(False))).select(*out, no_rank)))
