"""MinHash near-duplicates with sequential Bayesian verification.

One pass over the texts makes, per document, the distinct word shingles, a 128-bit digest of that set, a
MinHash signature and its band keys. Equal sets collapse to one representative. Representatives that
share a band bucket are candidates; signatures are compared in batches and a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold falls below ``miss_probability``;
every survivor is verified on the full sets.

Groups of thousands of copies never expand into all pairs: first every member is compared with one
centre of its buckets, and only buckets that still hold several components are searched further: small
ones pair by pair, large ones in blocks of rows that a task compares without emitting pairs.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from slicewatch.llm import words as W
from slicewatch.llm.common import cut_lineage, ship_package, text_blocks
from slicewatch.llm.graph import components


@dataclass(frozen=True)
class NearDup:
    """``shingle`` words per shingle; link if ``den * |A & B| >= num * |A | B|``. With 40 bands of 5 a
    pair at similarity 0.8 shares no band with probability 1e-7."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    bands: int = 40
    rows: int = 5
    step: int = 40                  # hashes compared between two looks at the posterior
    miss_probability: float = 1e-6  # a pair may be pruned wrongly with at most this posterior
    seed: int = 7
    small_bucket: int = 32          # buckets up to this size emit their open pairs
    block: int = 256                # rows per block of a large bucket's search
    broadcast_max_rows: int = 1_000_000


SKETCH_SCHEMA = "doc_id long, n_shingles long, set_hash binary, sig binary, bands array<long>"


def _set_of(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(W.shingles(h, np.zeros(len(h), np.int8), min(k, len(h)))[0])


def _sets(texts: pa.Array, k: int):
    """(row, sorted distinct shingles) of each text of an Arrow batch."""
    for block in text_blocks(texts):
        buf, s, e, doc = W.spans(block, W.NON_SPACE)
        h = W.hashes(buf, s, e)
        cut = np.searchsorted(doc, np.arange(len(block) + 1))
        for i in range(len(block)):
            yield block.first + i, _set_of(h[cut[i]:cut[i + 1]], k)


def _hash_family(p: NearDup):
    rng = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32),
            (rng.integers(0, 1 << 31, n, dtype=np.uint64) * 2 + 1).astype(np.uint32))


def _signatures(sets: list[np.ndarray], p: NearDup) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets, one row each."""
    xor, mul = _hash_family(p)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(xor)), np.uint32)
    for j in range(len(xor)):
        out[:, j] = np.minimum.reduceat((x ^ xor[j]) * mul[j], first)
    return out


def _band_keys(sig: np.ndarray, p: NearDup) -> np.ndarray:
    key = np.arange(1, p.bands + 1, dtype=np.uint64)[None, :].repeat(len(sig), 0)
    for r in range(p.rows):
        key = W.mix(key * np.uint64(0xA0761D6478BD642F) + sig[:, r::p.rows])
    return key.view(np.int64)


def _sketch(p: NearDup):
    def run(batches):
        for batch in batches:
            n_rows = batch.num_rows
            counts = np.zeros(n_rows, np.int64)
            digest, sigs, bands = [None] * n_rows, [None] * n_rows, [None] * n_rows
            rows, held, size = [], [], 0

            def flush():
                if not held:
                    return
                sig = _signatures(held, p)
                keys = _band_keys(sig, p)
                low = sig.astype(np.uint16)
                for k, row in enumerate(rows):
                    sigs[row], bands[row] = low[k].tobytes(), keys[k]

            for row, s in _sets(batch.column(1), p.shingle):
                counts[row] = len(s)
                if len(s):
                    digest[row] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    rows.append(row)
                    held.append(s)
                    size += len(s)
                    if size > 200_000:
                        flush()
                        rows, held, size = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_hash", "sig", "bands"])
    return run


def min_matches(p: NearDup) -> list[tuple[int, int]]:
    """(hashes seen, least matches to go on) at each look. With a uniform prior the posterior of the
    similarity after m matches of n is Beta(m + 1, n - m + 1), so P(sim >= t) = P(Bin(n + 1, t) <= m)."""
    t, out, total = p.num / p.den, [], p.bands * p.rows
    for n in range(p.step, total + 1, p.step):
        mass, m = 0.0, -1
        while mass < p.miss_probability and m < n:
            m += 1
            mass += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                             + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if 0 < t < 1 else 1.0
        out.append((n, m))
    return out


def _competitive(a: np.ndarray, b: np.ndarray, looks) -> np.ndarray:
    """Indexes of the signature pairs that survive every look."""
    alive, seen, got = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in looks:
        got = got + (a[alive, seen:n] == b[alive, seen:n]).sum(1)
        keep = got >= least
        alive, got, seen = alive[keep], got[keep], n
        if not len(alive):
            break
    return alive


def _linked(x: np.ndarray, y: np.ndarray, p: NearDup) -> bool:
    if p.den * min(len(x), len(y)) < p.num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return p.den * both >= p.num * (len(x) + len(y) - both)


def _bayes(p: NearDup):
    looks = min_matches(p)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, -1)
                        for c in (2, 3))
                yield part.select(["a", "b"]).take(pa.array(_competitive(a, b, looks)))
    return run


def _exact(p: NearDup):
    def run(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p)
                  for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _verified(pairs: DataFrame, members: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) that link: signatures first, survivors on the full sets."""
    def with_both(df, col):
        side = members.select("doc_id", col)
        return (df.join(side.select(F.col("doc_id").alias("a"), F.col(col).alias("x")), "a")
                .join(side.select(F.col("doc_id").alias("b"), F.col(col).alias("y")), "b").select("a", "b", "x", "y"))
    survivors = cut_lineage(with_both(pairs, "sig").mapInArrow(_bayes(p), "a long, b long"), "survivors")
    return cut_lineage(with_both(survivors, "set").mapInArrow(_exact(p), "a long, b long").distinct(), "links")


def _search_blocks(p: NearDup):
    looks = min_matches(p)

    def run(key, table):
        """Links between rows of two blocks that join components; no two rows already joined."""
        _, i, j = (k.as_py() for k in key)
        ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((ids, side))
        table = table.take(pa.array(order))
        ids, side, comp = ids[order], side[order], table.column("comp").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        band = sig.reshape(len(ids), p.bands, p.rows)
        roots = comp.copy()
        split = int(np.searchsorted(side, 1)) if i != j else len(ids)
        found = []
        for a in range(split):
            lo = a + 1 if i == j else split
            at = lo + np.flatnonzero(roots[lo:] != roots[a])
            at = at[(band[at] == band[a]).all(2).any(1)] if len(at) else at
            if not len(at):
                continue
            for b in at[_competitive(np.broadcast_to(sig[a], (len(at), sig.shape[1])), sig[at], looks)]:
                if roots[b] != roots[a] and _linked(sets[a], sets[b], p):
                    found.append((ids[a], ids[b]))
                    roots[roots == roots[b]] = roots[a]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})
    return run


def sketches(docs: DataFrame, p: NearDup, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_sketch(p), SKETCH_SCHEMA)


def _shingle_sets(docs: DataFrame, ids: DataFrame, few: bool, p: NearDup, doc_id: str, text: str) -> DataFrame:
    """(doc_id, set) of the documents in ``ids``. The id list is broadcast only if its checked count is ``few``."""
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            sets = [None] * batch.num_rows
            for row, s in _sets(batch.column(1), p.shingle):
                sets[row] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "set"])
    return wanted.mapInArrow(run, "doc_id long, set binary")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text",
                    unique_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links (itself included), ``kept`` marks that
    document. Words are the runs of non-space characters after lower-casing A-Z; a text with fewer words
    than a shingle is one shingle of its whole sequence. Null, empty and word-less texts have no
    shingles and link with nothing. Rows that repeat an id are one document: a link of any of them
    counts for the id. Rows with a null id are never linked: component null, kept true. An empty table
    gives an empty result; columns other than the two named are not read. ``unique_ids``: the caller has
    checked that no id repeats, so rows of one id need no search.
    """
    sk = cut_lineage(sketches(docs, p, doc_id, text), "sketches")
    usable = sk.filter(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())

    # equal sets: one representative each; only classes of several rows need a lookup
    copies = cut_lineage(usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
                         .filter("n > 1").select("set_hash", "rep"), "classes")
    node = sk.select("doc_id", "n_shingles", "set_hash").join(copies, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("node"))
    reps = usable.join(copies, "set_hash", "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")))

    # band buckets of two or more representatives, each member with its bucket's centre
    banded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"),
                                          F.count("*").alias("m")).filter("centre < last")
    member = cut_lineage(banded.join(shared.drop("last"), "bucket").select("bucket", "doc_id", "centre", "m"), "buckets")
    listed = Observation()
    ids = cut_lineage(member.select("doc_id").distinct().observe(listed, F.count(F.lit(1)).alias("n")), "candidates")
    sets = _shingle_sets(docs, ids, listed.get["n"] <= p.broadcast_max_rows, p, doc_id, text)
    rows = cut_lineage(sets.join(reps.select("doc_id", "sig"), "doc_id").select("doc_id", "sig", "set"), "members")

    # round 1: every member against one centre
    stars = (member.filter("doc_id <> centre").groupBy(F.col("doc_id").alias("b")).agg(F.min("centre").alias("a"))
             .select("a", "b"))
    links = _verified(stars, rows, p)
    if not unique_ids:
        links = links.unionByName(cut_lineage(_same_id(node), "same_id"))
    comp = components(links)

    # round 2: only what still lies in different components of one bucket
    placed = member.join(comp.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select(
        "bucket", "doc_id", "centre", "m", F.coalesce("label", "doc_id").alias("comp"))
    open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    large = Observation()
    still = cut_lineage(placed.join(open_buckets.select("bucket"), "bucket").observe(
        large, F.count(F.when(F.col("m") > p.small_bucket, 1)).alias("n")), "open")
    few = still.filter(F.col("m") <= p.small_bucket)
    left = few.select("bucket", F.col("doc_id").alias("a"), F.col("comp").alias("ca"))
    right = few.select("bucket", F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
    pairs = left.join(right, "bucket").filter("a < b and ca <> cb").select("a", "b").distinct()
    links = _verified(pairs.join(stars, ["a", "b"], "left_anti"), rows, p)
    if large.get["n"]:
        links = links.unionByName(_large_buckets(still.filter(F.col("m") > p.small_bucket), rows, p))
    comp = components(links, start=comp)
    return (node.join(comp.withColumnRenamed("label", "found"), "node", "left")
            .withColumn("component_id", F.coalesce("found", "node"))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _same_id(node: DataFrame) -> DataFrame:
    """Links of ids whose rows fall into several classes: such an id joins them."""
    split = node.filter("node is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    return node.join(split.select("doc_id"), "doc_id").filter("node <> doc_id").select(
        F.col("node").alias("a"), F.col("doc_id").alias("b"))


def _large_buckets(many: DataFrame, rows: DataFrame, p: NearDup) -> DataFrame:
    """Links found in buckets too large for pair rows: members of overlapping buckets form a group, its
    rows are dealt into blocks, and every two blocks meet in one task."""
    group = components(many, "doc_id", "centre")
    group = group.select(F.col("node").alias("doc_id"), F.col("label").alias("gid"))
    blocks = group.groupBy("gid").agg(F.ceil(F.count("*") / p.block).alias("nb"))
    dealt = (many.select("doc_id", "comp").distinct().join(group, "doc_id").join(blocks, "gid")
             .withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("nb"))).join(rows, "doc_id"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    meets = meets.select("doc_id", "comp", "sig", "set", "gid", F.least("mine", "other").alias("i"),
                         F.greatest("mine", "other").alias("j"),
                         F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"))
    return cut_lineage(meets.groupBy("gid", "i", "j").applyInArrow(_search_blocks(p), "a long, b long"), "links")
