"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of ``min_tile`` words (a seed) are joined on the hash of
that run. For each such pair the longest common runs of words are marked first, then the next longest
among what is still unmarked, down to ``min_tile`` words; window equality is found by running Karp-Rabin
hashes. The share of an item's words that tiles cover decides, so a passage whose sentences stand in
another order is caught as well.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.llm import words as W
from slicewatch.llm.common import cut_lineage, ship_package, text_blocks

_U = np.uint64


@dataclass(frozen=True)
class Tiling:
    min_tile: int = 5            # words of a seed and of the shortest tile
    min_cover: float = 0.6       # share of an item's words in tiles that makes a document contaminated
    filter_bits: int = 1 << 23   # fixed size of the filter that spares documents without any seed the join


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            self.up = np.concatenate([[_U(1)], np.cumprod(np.full(2 * n, _BASE, np.uint64))])
            self.down = np.concatenate([[_U(1)], np.cumprod(np.full(2 * n, _INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def windows(tokens: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every window of ``k`` tokens: a difference of two running sums,
    shifted back to the window's start."""
    n = len(tokens) - k + 1
    if k <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(tokens))
    run = np.concatenate([[_U(0)], np.cumsum(tokens * up)])
    return W.mix((run[k:] - run[:-k]) * down[:n] + _U(k))


#: Seed places that are laid out at a time: a text and an item that repeat one word meet in their product of places.
PLACES = 1 << 20


def _merge(t: np.ndarray, p: np.ndarray, n: np.ndarray):
    """Runs of seeds that follow one another on a diagonal as one run (text start, pattern start, seeds)."""
    by = np.lexsort((p, t - p))
    t, p, n = t[by], p[by], n[by]
    new = np.ones(len(t), bool)
    new[1:] = (np.diff(t - p) != 0) | (p[1:] != p[:-1] + n[:-1])
    start = np.flatnonzero(new)
    return t[start], p[start], np.add.reduceat(n, start)


def _runs(hits: np.ndarray, first: np.ndarray, times: np.ndarray, order: np.ndarray):
    """Maximal runs of shared seeds. The places (text window, equal pattern windows) are laid out slice by slice of the
    text and merged at once, so memory holds a slice and the runs."""
    upto = np.cumsum(times)
    found, lo = [], 0
    while lo < len(hits):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PLACES, side="right")))
        k = times[lo:hi]
        t = np.repeat(hits[lo:hi], k)
        p = order[np.repeat(first[lo:hi], k) + np.arange(len(t)) - np.repeat(np.cumsum(k) - k, k)]
        found.append(_merge(t, p, np.ones(len(t), np.int64)))
        lo = hi
    return _merge(*(np.concatenate(x) for x in zip(*found)))


def tiles(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (pattern start, text start, length), longest first."""
    least = max(1, min(least, len(pattern)))
    wt, wp = windows(text, least), windows(pattern, least)
    if not len(wt) or not len(wp):
        return []
    order = np.argsort(wp, kind="stable")
    lo, hi = np.searchsorted(wp[order], wt, "left"), np.searchsorted(wp[order], wt, "right")
    hits = np.flatnonzero(hi > lo)
    if not len(hits):
        return []
    t, p, size = _runs(hits, lo[hits], hi[hits] - lo[hits], order)
    size = size + least - 1
    heap = []
    for i, n in enumerate(size.tolist()):
        n_equal = int(np.argmin(np.append(text[t[i]:t[i] + n] == pattern[p[i]:p[i] + n], False)))  # no reliance on the hash
        if n_equal >= least:
            heap.append((-n_equal, int(p[i]), int(t[i])))
    heapq.heapify(heap)
    used_p, used_t, found, left = np.zeros(len(pattern), bool), np.zeros(len(text), bool), [], len(pattern)
    while heap and left >= least:
        n, ps, ts = heapq.heappop(heap)
        n = -n
        busy = used_p[ps:ps + n] | used_t[ts:ts + n]
        if not busy.any():
            used_p[ps:ps + n] = used_t[ts:ts + n] = True
            found.append((ps, ts, n))
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], busy.astype(np.int8), [1]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (a - b, ps + a, ts + a))
    return found


def _words(batch_texts):
    """(row, word hashes) of each text of an Arrow array."""
    for block in text_blocks(pc.utf8_lower(batch_texts)):  # every script, not A-Z alone
        buf, s, e, doc = W.spans(block, W.ALNUM)
        h = W.hashes(buf, s, e)
        cut = np.searchsorted(doc, np.arange(len(block) + 1))
        for i in range(len(block)):
            yield block.first + i, h[cut[i]:cut[i + 1]]


def _filter_slots(seed: np.ndarray, bits: int):
    """Three bit positions of each seed."""
    return [(W.mix(seed + _U(j)) % _U(bits)).astype(np.int64) for j in (1, 2, 3)]


def _by_id(docs: DataFrame, benchmark: DataFrame, p: Tiling, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """``decontaminate`` over documents that have an id."""
    spark = docs.sparkSession
    ship_package(spark)
    items = cut_lineage(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
                        .mapInArrow(_item_rows(p), "item_id long, n int, words binary, k int, seeds array<long>")
                        .withColumn("item", F.monotonically_increasing_id()), "items")     # a key of its own for every item
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    lengths = sorted({r["k"] for r in items.select("k").filter("k > 0").distinct().collect()})  # at most min_tile values
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, p))

    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_seeded_rows(p, lengths, bitmap), "doc_id long, words binary, seeds array<long>")
    marked = cut_lineage(marked.withColumn("row", F.xxhash64("doc_id", "words")), "seeded")
    pairs = (marked.select("doc_id", "row", F.explode("seeds").alias("seed")).join(seeds, "seed")
             .select("doc_id", "row", "item").distinct())
    tested = (pairs.join(marked.select("doc_id", "row", "words").distinct(), ["doc_id", "row"])
              .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
              .select("doc_id", "item_id", "words", "item_words").mapInArrow(_cover(p), "doc_id long, item_id long, coverage double"))
    best = (tested.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage")).groupBy("doc_id")
            .agg(F.max(F.struct("coverage", (-F.col("item_id")).alias("minus"))).alias("top"),
                 F.max("coverage").alias("coverage"),
                 F.sort_array(F.collect_list(F.when(F.col("coverage") >= p.min_cover, F.col("item_id")))).alias("items")))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id")).join(best, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("coverage") >= p.min_cover, F.lit(False)).alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        (-F.col("top.minus")).alias("item_id"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Tiling = Tiling(), doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, contaminated, items`` (ids over the threshold, ascending),
    ``item_id`` (best covered item, smallest id on ties; null without a shared seed), ``coverage``.

    Words are lower-cased runs of letters, digits and non-ASCII characters. An item shorter than
    ``min_tile`` words must stand whole. Null, empty and word-less texts or items match nothing. Rows that
    repeat an id count as one document: its best coverage holds. Rows without an id are judged by their own
    text each. Items without an id are tested like any other: they decide ``contaminated`` and ``coverage``
    and have no id to show. Empty tables give no or only clean rows. Other columns are not read.
    """
    named = _by_id(docs.filter(F.col(doc_id).isNotNull()), benchmark, p, doc_id, text, item_id, item_text)
    none = docs.filter(F.col(doc_id).isNull())
    if not none.limit(1).count():
        return named
    keyed = cut_lineage(none.select(F.monotonically_increasing_id().alias("key"), F.col(text).alias("text")), "no_id")
    judged = _by_id(keyed, benchmark, p, "key", "text", item_id, item_text).withColumn("doc_id", F.lit(None).cast("long"))
    return named.unionByName(judged)


def _item_rows(p: Tiling):
    def run(batches):
        for batch in batches:
            n, k, words, seeds = [], [], [], []
            for _, h in _words(batch.column(1)):
                size = min(p.min_tile, len(h))
                n.append(len(h))
                k.append(size)
                words.append(h.tobytes())
                seeds.append(np.unique(windows(h, size)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(words, pa.binary()), pa.array(k, pa.int32()),
                 pa.array(seeds, pa.list_(pa.int64()))], names=["item_id", "n", "words", "k", "seeds"])
    return run


def _bitmap(seeds: DataFrame, p: Tiling) -> np.ndarray:
    """Filter of fixed size over the items' seeds; its bits are gathered per 64-bit word."""
    def run(batches):
        for batch in batches:
            seed = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate(_filter_slots(seed, p.filter_bits)) if len(seed) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["slot", "bit"])
    rows = (seeds.select("seed").distinct().mapInArrow(run, "slot long, bit long").groupBy("slot")
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits"))).toArrow()
    out = np.zeros(p.filter_bits // 64, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _seeded_rows(p: Tiling, lengths: list[int], bitmap):
    def run(batches):
        bits = bitmap.value
        for batch in batches:
            rows, words, seeds = [], [], []
            for row, h in _words(batch.column(1)):
                hit = []
                for k in lengths:
                    seed = windows(h, k)
                    keep = np.ones(len(seed), bool)
                    for at in _filter_slots(seed, p.filter_bits):
                        keep &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1
                    hit.append(seed[keep])
                hit = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.uint64)
                if len(hit):
                    rows.append(row)
                    words.append(h.tobytes())
                    seeds.append(hit.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.binary()),
                 pa.array(seeds, pa.list_(pa.int64()))], names=["doc_id", "words", "seeds"])
    return run


def _cover(p: Tiling):
    def run(batches):
        for batch in batches:
            share = []
            for x, y in zip(batch.column(2), batch.column(3)):
                pattern = np.frombuffer(y.as_buffer(), np.uint64)
                found = tiles(np.frombuffer(x.as_buffer(), np.uint64), pattern, p.min_tile)
                share.append(sum(n for _, _, n in found) / len(pattern))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())],
                                             names=["doc_id", "item_id", "coverage"])
    return run
