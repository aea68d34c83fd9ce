"""The deciding stages of the pipeline against a plain decision per row."""

from __future__ import annotations

import re

import numpy as np

from slicewatch.llm import quality, tiling, toxicity
from slicewatch.llm.common import cut_lineage, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_take_the_decisions_of_single_rows(spark):
    import corpus_pipeline as cp
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.classify(docs, toxicity.learn(docs, labels)).collect()
    want = {r["doc_id"] for r in rows if r["score"] < toxicity.Learning.threshold}
    kept = cut_lineage(cp.drop_toxic(spark, docs, SF), "toxicity")
    assert ids(kept) == want and 0 < len(want) < len(rows)

    model = quality.train(kept, labels)
    rows = quality.classify(kept, model).collect()
    want = {r["doc_id"] for r in rows if r["score"] >= model.params.threshold}
    assert ids(cp.drop_poor(spark, kept, SF)) == want and 0 < len(want) < len(rows)

    names: dict[str, int] = {}

    def coded(text):
        return np.array([names.setdefault(w, len(names)) for w in WORD.findall((text or "").lower())], np.uint64)
    p = tiling.Tiling()
    items = [coded(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    texts = {r["doc_id"]: coded(r["text"]) for r in docs.select("doc_id", "text").collect()}
    want = {i for i, t in texts.items() if not any(
        len(x) and sum(n for _, _, n in tiling.tiles(t, x, p.min_tile)) >= p.min_cover * len(x) for x in items)}
    assert ids(cp.decontaminate(spark, docs, SF)) == want and 0 < len(want) < len(texts)
