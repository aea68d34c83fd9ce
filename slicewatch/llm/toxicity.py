"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Texts are folded first: case, accents of Latin letters, homoglyphs, full-width and mathematical letters, digits and signs that
stand for letters, invisible characters. The lexicon holds whole words and word stems with a weight; it
is learned from a bounded sample of labelled rows: the lower confidence bound of a term's log odds. All terms
are found in one automaton pass; matches inside an exception phrase don't count; a word counts once with
its heaviest term. The weights of a text, as a sum and per length, go through a logistic curve.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewatch.llm.common import TextBlock, bounded_rows, bounded_sample, ship_package, text_blocks

# Letters of other scripts that look like Latin ones, signs used in place of letters,
# characters without a shape.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
              "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n",
              "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
              "ı": "i", "ł": "l", "ø": "o"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "sore loser", "pond scum",
              "killing time", "stupid mistake")


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[tuple[str, float], ...]   # folded words; a trailing * marks a stem
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 1.0)   # bias, log of the sum, log of the density


@dataclass(frozen=True)
class Learning:
    max_rows_per_class: int = 3000   # bound of the labelled sample
    stems: tuple[int, ...] = (4, 5, 6, 7)
    min_docs: int = 3                # toxic documents that hold a term
    min_share: float = 0.005         # and their share of the toxic sample
    min_weight: float = 1.5
    caution: float = 1.64            # standard errors taken off a term's log odds
    threshold: float = 0.7


@functools.cache
def _fold_table() -> np.ndarray:
    """Folded code point by code point: a lower-case letter, 0x20 between words, 0 for nothing."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if 0x300 <= cp <= 0x36F:
            table[cp] = 0            # accents of their own
        elif unicodedata.category(ch)[0] in "LM":
            plain = unicodedata.normalize("NFD", ch)[0]      # accented Latin letters lose the accent
            low = (plain if plain.isascii() else ch).lower()
            table[cp] = ord(low) if len(low) == 1 else cp
        else:
            table[cp] = 0x20
    for lo, hi in ((0xFF00, 0xFFEF), (0x1D400, 0x1D7FF), (0x2460, 0x24FF), (0x2100, 0x214F)):  # styled letters
        for cp in range(lo, hi + 1):
            plain = unicodedata.normalize("NFKC", chr(cp)).lower()
            if len(plain) == 1:
                table[cp] = ord(SIGNS.get(plain, plain)) if plain.isalnum() else 0x20
    for ch, plain in (LOOKALIKES | SIGNS).items():
        table[ord(ch)] = table[ord(ch.upper())] = ord(plain)
    for ch in INVISIBLE:
        table[ord(ch)] = 0
    return table


def fold(text: str) -> str:
    cps = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return cps[cps != 0].astype(np.uint32).tobytes().decode("utf-32-le")


def _fold_block(block: TextBlock):
    """(folded stream, text index of each of its characters): every text begins and ends with a blank."""
    folded, sizes = [], []
    text = block.buf.tobytes()
    for s, e in zip(block.starts.tolist(), block.ends.tolist()):
        one = f" {fold(text[s:e].decode('utf-8', 'replace'))} "
        folded.append(one)
        sizes.append(len(one))
    return "".join(folded), np.cumsum(sizes)


def matcher(lexicon: Lexicon):
    """Automaton over words, stems and exception phrases; values are (weight, length of the key)."""
    found = ahocorasick.Automaton()
    for term, weight in lexicon.terms:
        key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
        found.add_word(key, (float(weight), len(key)))
    for phrase in lexicon.exceptions:
        key = f" {fold(phrase)} "
        found.add_word(key, (0.0, len(key)))
    if len(found):
        found.make_automaton()
    return found


def measure_block(block: TextBlock, found) -> tuple[np.ndarray, np.ndarray]:
    """(weight sum, word count) of each text."""
    stream, ends = _fold_block(block)
    n = len(block)
    cps = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    first = np.flatnonzero((cps[1:] != 0x20) & (cps[:-1] == 0x20)) + 1
    words = np.bincount(np.searchsorted(ends, first, side="right"), minlength=n)
    total = np.zeros(n)
    if not len(found):
        return total, words
    best: dict[int, float] = {}
    harmless: list[tuple[int, int]] = []
    for end, (weight, size) in found.iter(stream):
        begin = end - size + 2  # first letter: keys begin with a blank
        if not weight:
            harmless.append((begin, end))
        elif weight > best.get(begin, 0.0):
            best[begin] = weight
    for lo, hi in harmless:
        for at in range(lo, hi):
            best.pop(at, None)
    if best:
        at = np.fromiter(best, np.int64, len(best))
        total += np.bincount(np.searchsorted(ends, at, side="right"), weights=np.fromiter(best.values(), float, len(best)), minlength=n)
    return total, words


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns: log of the weight sum, log of the weight per 100 words."""
    return np.column_stack([np.log1p(total), np.log1p(100 * total / (words + 20))])


def score_measures(total: np.ndarray, words: np.ndarray, curve) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + _inputs(total, words) @ np.array(curve[1:]), -30, 30)))


def _terms(p: Learning):
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                seen = set(fold(text or "").split())
                out.append([*seen, *{f"{w[:n]}*" for w in seen for n in p.stems if len(w) >= n}])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["label", "terms"])
    return run


def learn(docs: DataFrame, labels: DataFrame, p: Learning = Learning(), doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon and curve from at most ``max_rows_per_class`` rows per class of ``labels`` (id, 0/1).

    Equal texts count once, and an id that repeats counts once per different text, inside the same bound. Labels other than 0 and 1, null ids and labels without a document are left
    out. Without both classes the lexicon is empty and every score is that of the default curve.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)")
    sample = bounded_sample(known.filter("label = 0"), "doc_id", p.max_rows_per_class).unionByName(
        bounded_sample(known.filter("label = 1"), "doc_id", p.max_rows_per_class))
    rows = bounded_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), sample,
                        p.max_rows_per_class).dropDuplicates(["label", "text"]).persist()
    try:
        size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if not size.get(0) or not size.get(1):
            return Lexicon((), exceptions)
        counts = (rows.mapInArrow(_terms(p), "label int, terms array<string>")
                  .select("label", F.explode("terms").alias("term")).groupBy("term")
                  .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
                  .filter(F.col("t") >= max(p.min_docs, p.min_share * size[1]))
                  .withColumn("weight", F.log((F.col("t") + 0.5) / (size[1] + 1.0)) - F.log((F.col("c") + 0.5) / (size[0] + 1.0))
                              - p.caution * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
                  .filter(F.col("weight") >= p.min_weight).orderBy("term"))   # bounded by the sample's words
        terms = tuple((r["term"], round(float(r["weight"]), 4)) for r in counts.collect())
        lexicon = Lexicon(terms, exceptions)
        measured = _measured(rows, lexicon).select("label", "total", "words").toPandas()  # bounded by the sample
    finally:
        rows.unpersist()
    measured = measured.sort_values(["label", "total", "words"])
    x = np.column_stack([np.ones(len(measured)), _inputs(measured["total"].to_numpy(), measured["words"].to_numpy())])
    return Lexicon(terms, exceptions, _fit(x, measured["label"].to_numpy()))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, both classes with equal weight."""
    w, ridge = np.zeros(x.shape[1]), np.diag([0.1, 1.0, 1.0])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (share * (y - q)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        found = matcher(shared.value)
        for batch in batches:
            total, words = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for block in text_blocks(batch.column(1)):
                part = slice(block.first, block.first + len(block))
                total[part], words[part] = measure_block(block, found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(words)], names=["label", "total", "words"])
    return rows.select("label", "text").mapInArrow(run, "label int, total double, words long")


def score_column(lexicon: Lexicon, text: Column, spark) -> Column:
    """Toxicity (0 to 1) of each text; null and empty texts get the curve's value at no match."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by the labelled sample
    held: list = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(matcher(shared.value))
        out = np.zeros(len(texts))
        for block in text_blocks(texts):
            out[block.first:block.first + len(block)] = score_measures(*measure_block(block, held[0]), shared.value.curve)
        return pa.array(out)
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, lexicon: Lexicon, threshold: float = Learning.threshold, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``; repeated rows score alike, null ids stay, an
    empty table gives an empty result, other columns are not read."""
    scored = docs.select(F.col(doc_id).alias("doc_id"),
                         score_column(lexicon, F.col(text), docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
