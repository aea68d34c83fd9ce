"""Quality classifier on learned subword embeddings.

A text is a bag of hashed features: words, pairs of neighbouring words (a pair of equal words is written
with a back reference) and character n-grams with their word boundary. Each bucket has a learned
vector; a document is the mean of its vectors and a softmax gives the label. Vectors and output layer
are trained together by numpy stochastic gradient descent on a bounded sample of labelled rows. For
scoring, every bucket's vector is multiplied with the output layer once, so a document needs one number
per feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewatch.llm import words as W
from slicewatch.llm.common import TextBlock, bounded_rows, bounded_sample, ship_package, text_blocks


@dataclass(frozen=True)
class Subwords:
    buckets: int = 1 << 17
    dim: int = 16
    orders: tuple[int, ...] = (3, 4)
    max_rows_per_class: int = 2000   # bound of the training sample
    epochs: int = 8
    rate: float = 0.6
    seed: int = 11
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray   # one number per bucket: its vector times the output layer (label 1 minus label 0)
    bias: float
    params: Subwords
    learned: bool = True  # false without labelled rows of both classes


def _code_points(buf: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The character that begins at each place of ``lead`` in UTF-8 bytes."""
    size = np.minimum(np.diff(np.append(lead, len(buf))), 4).astype(np.uint32)
    ch = buf[lead].astype(np.uint32)
    if len(lead) == len(buf):
        return ch
    ch = np.where(size > 1, ch & (np.uint32(0x7F) >> size), ch)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        ch[more] = (ch[more] << np.uint32(6)) | (buf[lead[more] + j] & 0x3F)
    return ch


def features(block: TextBlock, p: Subwords):
    """(bucket of every feature, its text index) of a block, repeats included, in groups."""
    buf, starts, ends, doc = W.spans(block, W.NON_SPACE, lower=False)
    h = W.hashes(buf, starts, ends)
    mask = np.uint64(p.buckets - 1)
    yield (h & mask).astype(np.int32), doc
    if len(h) > 1:
        same = np.flatnonzero(doc[1:] == doc[:-1])
        pair = np.where(h[same] == h[same + 1], np.uint64(12345), W.mix(h[same] * np.uint64(3) + h[same + 1]))
        yield (W.mix(pair) & mask).astype(np.int32), doc[same]
    # character n-grams: windows of one text whose inner characters are no white space
    owner = np.repeat(np.arange(len(block)), block.ends - block.starts)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    inside, owner = W.NON_SPACE[buf[lead]], owner[lead]
    ch = np.where(inside, _code_points(buf, lead), 32).astype(np.uint32)
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    n = len(ch)
    for k in p.orders:
        if n < k:
            continue
        m = n - k + 1
        g = np.full(m, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            g = (g ^ ch[j:j + m]) * np.uint32(0x01000193)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA6B)
        g ^= g >> np.uint32(13)
        ok = (owner[:m] == owner[k - 1:]) & (gaps[k - 1:k - 1 + m] - gaps[1:m + 1] == 0)
        yield (g[ok] & np.uint32(p.buckets - 1)).astype(np.int32), owner[:m][ok]


def _bag_rows(p: Subwords):
    def run(batches):
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                parts = list(features(block, p))
                bucket = np.concatenate([b for b, _ in parts])
                doc = np.concatenate([d for _, d in parts])
                key, count = np.unique(doc.astype(np.int64) * p.buckets + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(block) + 1) * p.buckets)
                feats, counts = [], []
                for i in range(len(block)):
                    f, c = key[cut[i]:cut[i + 1]] % p.buckets, count[cut[i]:cut[i + 1]]
                    feats.append(f.astype(np.int32))
                    counts.append(c.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(feats, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int32()))], names=["label", "feats", "counts"])
    return run


def _views(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """Every list as a view of the Arrow buffers: the training rows are held once in the driver."""
    out = []
    for chunk in lists.chunks:
        at, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [values[lo:hi] for lo, hi in zip(at[:-1], at[1:])]
    return out


def train(docs: DataFrame, labels: DataFrame, p: Subwords = Subwords(), doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model:
    """Fit on at most ``max_rows_per_class`` rows per class of ``labels`` (id, 0/1), chosen by id hash.

    Rows that repeat an id count once per different text, inside the same bound. Labels other than 0 and 1, null ids and labels without a document are left out. Without both classes
    the model has no weights and scores the share of label 1 (0.5 without any label).
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)")
    sample = bounded_sample(known.filter("label = 0"), "doc_id", p.max_rows_per_class).unionByName(
        bounded_sample(known.filter("label = 1"), "doc_id", p.max_rows_per_class))
    text_rows = bounded_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sample, p.max_rows_per_class)
    bags = text_rows.mapInArrow(_bag_rows(p), "label int, feats array<int>, counts array<int>").toArrow()
    y = bags.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(p.buckets, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), p, False)
    feats, counts = _views(bags.column("feats")), _views(bags.column("counts"))
    order0 = sorted(range(len(y)), key=lambda i: (int(y[i]), len(feats[i]), feats[i][:16].tolist()))
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (p.dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2) / len(y)
    steps, done = p.epochs * len(y), 0
    for _ in range(p.epochs):
        for i in rng.permutation(order0):
            f, c = feats[i], counts[i].astype(np.float32)
            rate = p.rate * (1 - done / steps)
            done += 1
            if not len(f):
                continue
            c = c / c.sum()
            hidden = c @ vectors[f]
            z = hidden @ out + bias
            z = np.exp(z - z.max())
            err = z / z.sum()
            err[y[i]] -= 1
            err *= 0.5 / share[y[i]] * rate  # both classes weigh the same
            back = out @ err
            out -= np.outer(hidden, err)
            bias -= err
            vectors[f] -= np.outer(c * np.sqrt(len(f)), back).astype(np.float32)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), p)


def score_block(block: TextBlock, model: Model) -> np.ndarray:
    total, n = np.zeros(len(block)), np.zeros(len(block))
    for bucket, doc in features(block, model.params):
        total += np.bincount(doc, weights=model.weights[bucket], minlength=len(block))
        n += np.bincount(doc, minlength=len(block))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -30, 30)))


def score_column(model: Model, text: Column, spark) -> Column:
    """Probability of label 1 for each text: null and empty texts get the model's bias alone."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: one float per bucket

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for block in text_blocks(texts):
            out[block.first:block.first + len(block)] = score_block(block, shared.value)
        return pa.array(out)
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``; repeated rows score alike, null ids stay, an
    empty table gives an empty result, other columns are not read."""
    scored = docs.select(F.col(doc_id).alias("doc_id"),
                         score_column(model, F.col(text), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.params.threshold).cast("int"))
