"""Classifiers, near-duplicates, archives, URL filter and the pipeline on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from slicewatch.llm import neardup, quality, queries, toxicity, urls, warc
from slicewatch.llm.common import fold_of, table
from slicewatch.llm.neardup import NearDup, near_duplicates

SF = "/root/testdata/sf0.01"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- near-duplicates -------------------------------------------------------------------------------

def brute_components(docs, k, num=80, den=100):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def noisy(rng, words, share):
    return " ".join(f"z{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("small_bucket, block, k", [(32, 256, 2), (2, 16, 2), (32, 256, 5)])
def test_components_equal_brute_force(spark, small_bucket, block, k):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    docs = [(i, noisy(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05, 0.08]))) for i in range(90)]
    docs += [(100 + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(200, "One"), (201, "one"), (202, " one\t"), (203, ""), (204, None), (205, "   "), (206, "one two"), (207, "ONE TWO"),
             (208, "one two three four"), (209, "a " * 20000), (210, "a " * 10), (None, "one"), (211, docs[0][1]), (211, docs[100][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, node string")
    got = near_duplicates(df, NearDup(shingle=k, small_bucket=small_bucket, block=block)).collect()
    want = brute_components(docs, k)
    assert len(got) == len(docs)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(want.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_pruning_keeps_competitive_pairs():
    p = NearDup()
    looks = neardup.min_matches(p)
    assert [n for n, _ in looks] == [40, 80, 120, 160, 200]
    assert all(m < 0.8 * n for n, m in looks)          # a pair at the threshold goes on
    assert all(m > 0.4 * n for n, m in looks[1:])      # a pair at half of it does not


# --- classifiers -----------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = fold_of(F.col("doc_id"), 5)
    model = quality.train(docs, labels.filter(fold != 0))
    got = quality.classify(docs, model).join(labels.filter(fold == 0), "doc_id").select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in got) >= 0.97 * len(got) > 0
    odd = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "x " * 100_000, 5)], "doc_id long, text string, score int")
    rows = quality.classify(odd, model).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"]
    assert quality.classify(odd.limit(0), model).collect() == []


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, quality.train(docs, none)).first()["score"] == pytest.approx(0.5)
    one = spark.createDataFrame([(1, 1), (None, 0), (1, 7)], "doc_id long, quality int")
    assert quality.classify(docs, quality.train(docs, one)).first()["predicted"] == 1


def test_toxicity_folding_exceptions_and_scores(spark):
    assert toxicity.fold("1d10t ІDIOT ｌｏｓｅｒ tr\u200bash m0r0n") == "idiot idiot loser trash moron"
    lexicon = toxicity.Lexicon((("idiot", 4.0), ("trash", 3.0), ("lowei*", 5.0)), exceptions=("trash can",), curve=(-3.0, 2.0, 1.0))
    texts = ["you 1d10t", "the trash can is full", "trash can, trash", "Loweischaft", "idiotic", "", None, "xidiot", "IDIOT " * 50, "a " * 50_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    got = {r["doc_id"]: r for r in toxicity.classify(df, lexicon).collect()}
    assert [got[i]["predicted"] for i in range(len(texts))] == [1, 0, 1, 1, 0, 0, 0, 0, 1, 0]
    assert got[5]["score"] == got[6]["score"] == got[1]["score"] == got[7]["score"]
    long = spark.createDataFrame([(0, "idiot"), (1, "idiot " + "word " * 5000)], "doc_id long, text string")
    short, diluted = (r["score"] for r in toxicity.classify(long, lexicon).orderBy("doc_id").collect())
    assert short > diluted  # normalised by length
    assert toxicity.classify(df.limit(0), lexicon).collect() == []


def test_toxicity_learned_from_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = fold_of(F.col("doc_id"), 3)
    lexicon = toxicity.learn(docs, labels.filter(fold != 1))
    got = toxicity.classify(docs, lexicon).join(labels.filter(fold == 1), "doc_id").select("toxic", "predicted").collect()
    assert sum(r["toxic"] == r["predicted"] for r in got) >= 0.95 * len(got) > 0
    assert toxicity.learn(docs, labels.limit(0)).terms == ()


# --- URL filter ------------------------------------------------------------------------------------

def test_url_rules_equal_brute_force(spark):
    given = [None, "", "no scheme", "http://", "http://NET", "https://a.net/x", "https://www.Example.NET/en/1?q=/fr/", "http://example.net/en",
             "http://x.example.com/de/1", "http://example.com/DE/1", "http://notexample.com/de/", "http://é.org/fr/#a", "ftp://org?x=/fr/",
             "http://a.org#/fr/", "http://cheap-pills.example.com/1\n2", "x://y://net/"]
    rules = queries.RULES
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df, rules).collect()}
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best.name if best else None), u
        assert urls.split(u or "") == (host, path)
        assert got[i]["verdict"] == (best.verdict if best else ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert got[14]["verdict"] == "block" and got[11]["verdict"] == "allow"
    assert urls.judge(df.limit(0), rules).collect() == []
    assert urls.judge(df, model=urls.train([])).filter("verdict = 'block'").count() == 0


# --- archives --------------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    big, odd = "é" * 600, "x\r\n\r\nWARC/1.1\r\n\r\n" * 80
    pages = [(1, "http://b.org/1", big), (2, "http://a.org/1", big), (3, "http://a.org/1", "short"), (4, None, "short"), (5, "http://a.org/\r\nX: y", odd),
             (6, "http://c.org", None), (7, "http://c.org", ""), (None, "http://n.org", big), (9, "http://a.org/1", big), (10, "http://z.org", "q" * 300_000),
             (11, "http://z.org", odd)]
    df = spark.createDataFrame([(i, u, h, "d") for i, u, h in pages], "page_id long, url string, html string, digest string")
    index = warc.archive_pages(df).orderBy("shard", "position").collect()
    assert len(index) == len(pages)
    got = {r["page_id"]: r for r in index}
    for i, u, h in pages:
        raw = (h or "").encode()
        same = [j for j, _, x in pages if x == h and j is not None]
        top = max(same, default=None) if len(raw) >= 1000 else None
        revisit = top is not None and (i is None or i < top)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", top) if revisit else ("response", None))
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in index]
    assert keys == sorted(keys)
    assert got[3]["url_key"] == "org,a)/1"
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        runs = [[(x, i) for x in run] for i, run in enumerate(runs)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


# --- registered queries and the pipeline -----------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = c.execute(queries.SQL[name])
    names = [d[0] for d in out.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(out.fetchall(), key=key)


def test_near_dedup_query_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = queries.op7_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(docs, 2)


def test_pipeline_keeps_columns_and_takes_decisions(spark):
    import corpus_pipeline as cp
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("other_id", F.lit("x"))
    columns, kept = docs.columns, None
    for name, stage in cp.STAGES[:-1]:
        after = cp.cut_lineage(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert after.columns == columns
        ids = {r[0] for r in after.select("doc_id").collect()}
        before = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "near_dedup":
            texts = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
            assert ids == {i for i, c in brute_components(texts, 5).items() if i == c}
        docs, kept = after, ids
    last = cp.tokens(spark, docs, "/root/testdata/sf0.001").collect()
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in last} == kept
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in last)


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as cp
    rows = [(1, None), (2, ""), (None, "plain words here"), (3, "same text of several words"), (4, "same text of several words"), (3, "same text of several words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = cp.near_dedup(spark, docs, "")
    assert sorted((str(r[0]), r[1]) for r in out.collect()) == [("1", None), ("2", ""), ("3", "same text of several words"), ("None", "plain words here")]
    sf = "/root/testdata/sf0.001"
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0
