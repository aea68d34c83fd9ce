"""What near_dedup and the quality training leave in the driver: jobs (plans, threads, compiled code) and copies of rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from slicewatch.llm import quality
from slicewatch.llm.graph import components, star_centres
from test_classify_and_dedup import brute_components, noisy
from test_components import brute


def test_near_dedup_takes_few_jobs(spark):
    import corpus_pipeline as cp
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    docs = [(i, noisy(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03]))) for i in range(80)]
    docs += [(100 + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(40))) for i in range(40)] + [(200, ""), (201, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sc = spark.sparkContext
    sc.setJobGroup("near_dedup", "jobs of one stage")
    try:
        got = {r["doc_id"] for r in cp.near_dedup(spark, df, "").collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert got == {i for i, c in brute_components(docs, 5).items() if i == c} and len(got) < 100
    assert len(sc.statusTracker().getJobIdsForGroup("near_dedup")) <= 115


def test_edges_contracted_in_tasks_keep_nodes_and_components(spark):
    for seed in range(40):
        rng = random.Random(seed)
        edges = [(rng.randint(-5, 60), rng.randint(-5, 60)) for _ in range(rng.randint(1, 60))]
        node, centre = star_centres(*np.array(edges).T)
        assert dict(zip(node.tolist(), centre.tolist())) == brute(edges)
    chain = random.Random(1).sample(range(1000), 120)
    edges = [*zip(chain, chain[1:]), (2000, 2000), (2001, 2002), (2002, 2001)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    assert len(got) == 123 and {r["node"]: r["label"] for r in got} == brute(edges)
    more = [(3000, 3001), (3001, chain[5]), (2000, 2002), (chain[0], chain[9])]  # added to what is known
    first = components(spark.createDataFrame(edges, "a long, b long"))
    got = components(spark.createDataFrame(more, "a long, b long").repartition(3), start=first).collect()
    assert len(got) == 125 and {r["node"]: r["label"] for r in got} == brute(edges + more)


def test_training_rows_are_views_of_the_received_buffers():
    lists = pa.chunked_array([pa.array([[9], [1, 2], [], [3]], pa.list_(pa.int32())).slice(1), pa.array([[4, 5]], pa.list_(pa.int32()))])
    views = quality._views(lists)
    assert [v.tolist() for v in views] == [[1, 2], [], [3], [4, 5]]
    assert np.shares_memory(views[0], lists.chunk(0).values.to_numpy()) and np.shares_memory(views[3], lists.chunk(1).values.to_numpy())
