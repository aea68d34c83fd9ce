"""Pipeline stages on rows whose ids are missing or repeat."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string"


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


def near(text):
    return text + " tail"


@pytest.mark.parametrize("parts", [1, 7])
def test_near_dedup_decides_per_row(spark, parts):
    import corpus_pipeline as cp
    a, b, c, d, e = (passage(i) for i in range(5))
    rows = [(1, a), (3, near(a)), (3, b), (5, near(b)), (7, c), (7, d), (7, d), (8, e), (None, near(e)), (None, passage(9)),
            (None, near(passage(9))), (None, None), (None, ""), (2, ""), (2, ""), (2, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(parts)
    out = cp.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    # b survives under id 3 although (3, near(a)) goes, both texts of id 7 stay, copies without an id go
    fixed = [(1, a), (3, b), (7, c), (7, d), (8, e), (None, None), (None, ""), (2, ""), (2, None)]
    rest = [x for x in got if x[0] is None and x[1]]
    assert len(rest) == 1 and rest[0][1] in (passage(9), near(passage(9)))
    assert sorted((x for x in got if x not in rest), key=str) == sorted(fixed, key=str)


def test_decontamination_judges_rows_without_id(spark, tmp_path):
    import corpus_pipeline as cp
    from slicewatch.llm import queries
    item, other = passage(20, 30), passage(21, 30)
    rows = [(None, "see " + item), (None, other), (None, None), (3, "see " + item), (3, other), (4, other)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(None, other), (None, None), (3, other), (4, other)], key=str)
    got = queries.op10_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["contaminated"], r["items"]) for r in got), key=str) == sorted(
        [(None, True, [10]), (None, False, []), (None, False, []), (3, True, [10]), (3, True, [10]), (4, False, [])], key=str)


@pytest.mark.parametrize("labels", [[(1, 0), (2, 0)], []])
def test_quality_stage_keeps_all_without_both_classes(spark, tmp_path, labels):
    import corpus_pipeline as cp
    docs = spark.createDataFrame([(i, passage(i), "x") for i in range(5)], SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.drop_poor(spark, docs, str(tmp_path)).count() == 5
