"""Bounded training rows, items without an id, repetitive texts, and character classes of the tokenizer library."""

from __future__ import annotations

import base64
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from slicewatch.llm import bpe, quality, tiling, toxicity
from slicewatch.llm.common import bounded_rows, text_blocks


def test_training_rows_stay_bounded_when_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(1, "text 5")] * 500 + [(i, f"other {i}") for i in range(2, 40)],
                                 "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, label int")
    rows = [tuple(r) for r in bounded_rows(docs, sample, 50).collect()]
    assert sum(x == 1 for x, _ in rows) == 50 and sum(x == 0 for x, _ in rows) == 19
    assert len(set(rows)) == len(rows)
    again = [tuple(r) for r in bounded_rows(docs.repartition(7), sample, 50).collect()]
    assert sorted(again) == sorted(rows)                       # chosen by ids and texts, not by partitions
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, quality.Subwords(max_rows_per_class=20, epochs=1)).learned
    assert isinstance(toxicity.learn(docs, labels, toxicity.Learning(max_rows_per_class=20)), toxicity.Lexicon)


def test_all_learned_terms_are_kept(spark):
    words = [f"w{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x" for i in range(6000)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(40)] + [(100 + i, "calm words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.learn(docs.withColumn("text", toxicity.F.concat("text", toxicity.F.lit(" "), toxicity.F.col("doc_id").cast("string"))), labels)
    assert sum(not t.endswith("*") for t, _ in rows.terms) >= 6000


def test_accents_do_not_hide_a_word():
    assert toxicity.fold("ídiot i\u0301diot ÎDÍOT idiot") == " ".join(["idiot"] * 4)
    assert toxicity.fold("ёлка йод") == "ёлка йод".replace("к", "k").replace("а", "a").replace("о", "o")


def test_items_without_an_id_are_tested(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {item} it goes"), (2, "nothing of it"), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, "another item that nobody quotes at all")], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"], r["item_id"], r["coverage"]) for r in tiling.decontaminate(docs, bench).collect()}
    assert got == {1: (True, [], None, 1.0), 2: (False, [], None, 0.0), None: (True, [], None, 1.0)}


def brute_tiles(text, pattern, least):
    used_t, used_p, covered = [False] * len(text), [False] * len(pattern), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and not used_p[p + n] and not used_t[t + n] and pattern[p + n] == text[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return covered
        used_p[p:p + n], used_t[t:t + n] = [True] * n, [True] * n
        covered += n


def test_sliced_seed_places_give_the_same_tiles(monkeypatch):
    rng = random.Random(2)
    for places in (1, 7, 1 << 20):
        monkeypatch.setattr(tiling, "PLACES", places)
        for _ in range(25):
            words = rng.randrange(2, 5)
            text, pattern = ([rng.randrange(words) for _ in range(rng.randrange(1, n))] for n in (60, 25))
            found = tiling.tiles(np.array(text, np.uint64), np.array(pattern, np.uint64), 3)
            assert sum(n for _, _, n in found) == brute_tiles(text, pattern, min(3, len(pattern)))


def test_a_long_repetitive_text_stays_small():
    text, pattern = np.full(300_000, 7, np.uint64), np.full(300, 7, np.uint64)
    tiling.tiles(text[:1000], pattern, 5)                       # tables of powers
    tracemalloc.start()
    found = tiling.tiles(text, pattern, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, _, n in found) == 300
    assert peak < 400 << 20                                     # all places at once would be several GB


def test_every_code_point_encodes_as_the_library_does():
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Vocabulary(path)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 40_000):
        texts = [f"a{c}'ve{c}1 {c}{c}  {c}'s." for c in chars[lo:lo + 40_000]]
        got = np.concatenate([mine.encode_block(b)[0] for b in text_blocks(pa.array(texts))])
        assert got.tolist() == [i for t in texts for i in library.encode_ordinary(t)]


def test_url_regression_on_hosts_it_has_not_seen(spark):
    from slicewatch.llm import urls
    table = urls.labelled_urls()
    companions = [c for words in (urls.JUNK_TRADES, urls.PLAIN_SUBJECTS) for _ in words for c in urls.COMPANIONS]
    right = [(score >= 0.5) == bool(label) for label, score in urls.held_out(table, companions)]
    assert len(right) == len(table) and sum(right) >= 0.95 * len(right)
    # windows are over characters, and scores equal a plain reading of the model
    model = urls.train(table)
    import zlib
    for url in ("https://www.my-casino.io/é漢字/x", "https://" + "a" * 50_000 + ".org/", "", "no url"):
        host, path = urls.split(url)
        slots = [zlib.crc32(part[i:i + n].encode(), zlib.crc32(mark)) % len(model.weights)
                 for mark, part in ((b"h", f"^{host}$"), (b"p", f"^{path}$")) for n in model.orders for i in range(len(part) - n + 1)]
        z = model.bias + (sum(float(model.weights[s]) for s in slots) / len(slots) ** 0.5 if slots else 0)
        df = spark.createDataFrame([(None, url)], "page_id long, url string")
        assert urls.judge(df, model=model).first()["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
