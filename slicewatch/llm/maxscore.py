"""Exact top-k search by inner product with MaxScore pruning.

Vectors are scaled to integers; a dimension is a query term and a block of rows is a shard of its
postings. Within a shard the largest contribution of each term bounds what it can add. Terms are split
by those bounds: as long as the non-essential ones together cannot lift a row over the current k-th
best score, only the essential postings are traversed for all rows, and the others are probed, largest
bound first, while a row stays competitive. Shard results are merged per query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, ship_package


@dataclass(frozen=True)
class Search:
    k: int = 20
    shard_rows: int = 4096    # rows of one shard
    query_rows: int = 1024    # queries of one block
    warm_rows: int = 256      # rows scored in full to find a first threshold
    probe: int = 8            # non-essential terms probed between two looks at the threshold


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component, x as double; null where the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _packed(rows: DataFrame, blocks: int, name: str, id_col: str) -> DataFrame:
    """One row per block: ids and matrix as bytes. Rows are dealt by the hash of their id and their place in
    the written table, so copies of one vector, and rows that repeat one id, spread over all blocks."""
    def run(key, table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = table.column("v").combine_chunks() if table.num_rows else None
        width = max((len(x) for x in lists), default=0)
        out = np.zeros((len(ids), width), np.int64)  # shorter vectors end in zeros
        for i, x in enumerate(lists):
            out[i, :len(x)] = x.values.to_numpy()
        return pa.table({name: pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "matrix": pa.array([np.ascontiguousarray(out[order]).tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})
    dealt = rows.select(F.col(id_col).alias("id"), "v", F.pmod(
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(blocks)).alias(name))
    return dealt.groupBy(name).applyInArrow(run, f"{name} long, ids binary, matrix binary, width int")


def _best(ids, score, own, k):
    """Indexes of the k best candidates: score descending, id ascending, never the query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        floor = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= floor]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, p: Search):
    """(query position, row id, score) of the best rows of one shard for each query of a block."""
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    size = width * int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0))
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else object  # exact in each case
    terms = np.ascontiguousarray(x.T).astype(kind)
    top, low = x.max(0).astype(kind), x.min(0).astype(kind)
    q = q.astype(kind)
    warm = min(len(ids), max(p.warm_rows, 2 * p.k))
    for j in range(len(q)):
        bound = np.maximum(q[j] * top, q[j] * low)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bound of all terms from a place on
        first = q[j] @ terms[:, :warm]
        best = _best(ids[:warm], first, query_ids[j], p.k)
        held_ids, held = ids[:warm][best], first[best]
        if warm < len(ids):
            limit = held[-1] if len(held) == p.k else None
            essential = width
            if limit is not None:
                essential = max(1, int(np.argmax(rest <= limit)) if (rest <= limit).any() else width)
            use = order[:essential]
            score = q[j][use] @ terms[use, warm:]
            rows = np.arange(warm, len(ids))
            while True:
                if limit is not None:
                    alive = score + rest[essential] >= limit
                    rows, score = rows[alive], score[alive]
                if essential == width or not len(rows):
                    break
                use = order[essential:essential + p.probe]
                score = score + q[j][use] @ terms[np.ix_(use, rows)]
                essential = min(width, essential + p.probe)
            all_ids, all_score = np.concatenate([held_ids, ids[rows]]), np.concatenate([held, score])
            best = _best(all_ids, all_score, query_ids[j], p.k)
            held_ids, held = all_ids[best], all_score[best]
        yield j, held_ids, held


def top_k(queries: DataFrame, rows: DataFrame, p: Search = Search(), id_col: str = "vec_id", vector: str = "embedding",
          scale: int = 64) -> DataFrame:
    """The ``k`` best of ``rows`` for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Score: inner product of the scaled vectors, ties to the smaller id; a query never meets rows of its
    own id. Null vectors, vectors with null or non-finite components and rows with a null id take no part;
    of vectors of different lengths the shorter ends in zeros (an empty vector scores 0). Repeated rows are
    candidates and queries of their own: a repeated query id gives one ranking per row. With fewer
    candidates than ``k`` all are returned; empty tables give an empty result. Scores beyond the long
    range are cut to it. Other columns are not read.
    """
    spark = rows.sparkSession
    ship_package(spark)

    def usable(df):
        return cut_lineage(df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector), scale).alias("v"))
                           .filter(F.col("id").isNotNull() & F.col("v").isNotNull()), "vectors")
    rows, queries = usable(rows), usable(queries)
    shards = max(1, -(-rows.count() // p.shard_rows))
    blocks = max(1, -(-queries.count() // p.query_rows))
    shard = cut_lineage(_packed(rows, shards, "shard", "id"), "shards")
    block = _packed(queries, blocks, "block", "id").select(
        "block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"))
    # the stated query set against all rows, block by block: each shard is named once per query block
    work = shard.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(
        cut_lineage(block, "queries"), "block").repartition(max(1, shards * blocks), "shard", "block")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                x = np.frombuffer(row["matrix"], np.int64).reshape(len(ids), row["width"])
                q = np.frombuffer(row["q_matrix"], np.int64).reshape(len(q_ids), row["q_width"])
                at, found, score = [], [], []
                for j, best, s in search_shard(ids, x, q_ids, q, p):
                    at.append(np.full(len(best), j))
                    found.append(best)
                    score += [min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s]
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["block"])), pa.array(at.astype(np.int32)), pa.array(q_ids[at]),
                     pa.array(np.concatenate(found)), pa.array(score, pa.int64())],
                    names=["block", "place", "query_id", "vec_id", "score"])
    found = work.select("block", "ids", "matrix", "width", "q_ids", "q_matrix", "q_width").mapInArrow(
        run, "block long, place int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
