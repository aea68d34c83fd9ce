"""Connected components on shapes that minimum labels alone settle slowly."""

from __future__ import annotations

import random

from slicewatch.llm.graph import components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in parent}


def test_long_chains_and_odd_shapes_settle(spark):
    rng = random.Random(3)
    chain = rng.sample(range(1000, 9000), 500)
    falling = [10_000, *range(10_999, 10_799, -1)]            # the smallest id at the far end of falling ones
    hubs = [(20_900 + i // 5, 20_000 + i + j) for i in range(0, 100, 5) for j in range(6)]  # large hubs share small leaves
    edges = [*zip(chain, chain[1:]), *zip(falling, falling[1:]), *hubs, (5, 5), (6, 7), (7, 6)]
    edges += [(rng.randint(30_000, 30_400), rng.randint(30_000, 30_400)) for _ in range(220)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = brute(edges)
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
