"""Importance resampling, cross-tokenizer alignment and sharding against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slicewatch.llm import crosstok, crc, importance, sharding
from slicewatch.llm.common import cut_lineage, text_blocks
from slicewatch.llm.crosstok import Counting, CrossTokens
from slicewatch.llm.importance import Resampling
from slicewatch.llm.order import running_totals

DOCS = "doc_id long, text string, Row int"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- checksums and positions -------------------------------------------------------------------------

def test_crc_of_spans_equals_zlib():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    buf = np.frombuffer(raw, np.uint8)
    starts = np.array([rng.randrange(4000) for _ in range(300)] + [0, 7])
    ends = starts + np.array([rng.choice([0, 1, 2, 5, 9, 64, 65, 300]) for _ in range(300)] + [5000, 0])
    got = crc.crc32_spans(buf, starts, ends)
    assert got.tolist() == [zlib.crc32(raw[s:e]) for s, e in zip(starts, ends)]
    more = crc.crc32_spans(buf, starts, ends, crc.crc32_byte(0x20, got))
    assert more.tolist() == [zlib.crc32(raw[s:e] + b" " + raw[s:e]) for s, e in zip(starts, ends)]
    assert len(crc.crc32_spans(buf, starts[:0], ends[:0])) == 0


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(2)
    keys = [7] * 400 + [rng.randrange(50) for _ in range(600)]
    rows = [(k, rng.randrange(100), i) for i, k in enumerate(keys)]
    df = cut_lineage(spark.createDataFrame(rows, "k long, size long, row long").repartition(5), "t")
    got = sorted(rows_of(running_totals(df, [F.col("k"), F.col("row")])), key=lambda r: r[3])
    want, total = [], 0
    for i, (k, size, row) in enumerate(sorted(rows, key=lambda r: (r[0], r[2]))):
        want.append((k, size, row, i, total))
        total += size
    assert got == want
    assert rows_of(running_totals(df.limit(0), [F.col("k"), F.col("row")])) == []


# --- importance resampling ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text, p):
    w = WORD.findall(ascii_lower(text))
    return w, [" ".join(w[i:i + n]) for n in range(p.min_n, p.max_n + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, p):
    def buckets(texts):
        return Counter(zlib.crc32(f.encode()) % p.buckets for t in texts for f in brute_features(t, p)[1])
    s, t = buckets([d[1] for d in docs]), buckets(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets)))) for b in range(p.buckets)]
    out = []
    for i, text in docs:
        w, f = brute_features(text, p)
        weight = sum(gain[zlib.crc32(x.encode()) % p.buckets] for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(w), len(f), weight, score, None])
    may = sorted((r for r in out if r[1] >= p.min_words and r[4] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    for k, r in enumerate(may[:len(may) * p.draw // p.of]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def some_texts(rng, n):
    words = ["alpha", "Beta", "gamma", "δέλτα", "x1", "9", "naïve", "it's", "a-b", "漢字"]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    return ["\n".join(rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
                      for _ in range(rng.randrange(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("p", [Resampling(buckets=97, min_words=3), Resampling(min_n=1, max_n=3, buckets=500, min_words=0, draw=1, of=3),
                               Resampling(min_n=2, max_n=2, buckets=64, min_words=5, draw=100)])
def test_resampling_equals_brute_force(spark, p):
    rng = random.Random(5)
    docs = list(enumerate(some_texts(rng, 150)))
    docs += [(200, None), (201, ""), (202, "\n\n \r\n"), (203, "w" * 500 + " tail"), (None, docs[3][1]), (7, docs[7][1]),
             (7, docs[9][1]), (204, "long " * 60_000)]
    target = some_texts(rng, 20) + [None, "", "gamma\r\ngamma"]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, Score int").repartition(3)
    to = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(rows_of(importance.resample(df, to, p)), key=repr) == brute_resample(docs, target, p)


def test_resampling_draws_copies_by_id_and_handles_empty_tables(spark):
    text = " ".join(["same"] * 30)
    df = spark.createDataFrame([(i, text) for i in range(100)], "doc_id long, text string")
    got = rows_of(importance.resample(df, df.select("text").limit(0)))
    drawn = sorted((r for r in got if r[5]), key=lambda r: r[5])
    assert [r[5] for r in drawn] == list(range(1, 11))
    assert [r[0] for r in drawn] == [r[0] for r in sorted(got, key=lambda r: (-r[4], r[0]))[:10]]
    assert rows_of(importance.resample(df.limit(0), df.select("text"))) == []


def test_distinct_lines_are_counted_once(spark):
    df = spark.createDataFrame([("One two\nthree",), ("one TWO",), ("three\none two\n",), (None,)], "text string")
    assert sorted(rows_of(importance.distinct_lines(df))) == [("one two", 3), ("three", 2)]
    p = Resampling(min_n=2, max_n=2, buckets=1000)
    counts = Counter(zlib.crc32(f.encode()) % 1000 for f in ["one two"] * 3 + ["two three", "three one"])
    assert dict(rows_of(importance.bucket_counts(df, p))) == dict(counts)


# --- cross-tokenizer alignment -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer_files():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute_align(texts, files):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    one, two = Tokenizer.from_file(files[0]), SentencePieceProcessor(model_file=files[1])
    one.encode_special_tokens = True
    chars = crosstok._byte_of_char()
    piece_a = {i: s for s, i in one.get_vocab().items()}

    def bytes_a(i):
        return bytes(chars[c] for c in piece_a[i])

    def bytes_b(i):
        s = two.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if two.is_byte(i) else s.replace("▁", " ").encode()
    docs, holders = [], defaultdict(int)
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
        begin_a, begin_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
        links = Counter()
        for i in range(len(a)):
            for j in range(len(b)):
                if begin_a[i] < ends_b[j] and begin_b[j] < ends_a[i]:
                    links[a[i], b[j]] += 1
        groups, x, y = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            ga, gb = [], []
            while x < len(a) and ends_a[x] <= e:
                ga.append(str(a[x]))
                x += 1
            while y < len(b) and ends_b[y] <= e:
                gb.append(str(b[y]))
                y += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((len(a), len(b), groups, links))
        for k in links:
            holders[k] += 1
    top = defaultdict(int)
    for (a, _), n in holders.items():
        top[a] = max(top[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, groups, links = d
            out.append((n_a, n_b, len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(),
                        sum(n for k, n in links.items() if holders[k] == top[k[0]]), sum(n * holders[k] for k, n in links.items())))
    return out, holders, top


def align_texts():
    rng = random.Random(11)
    words = ["the", "tokenizer", " naïve", "漢字", "🙂", "12345", "don't", "\t", "\n\n", "  ", "ﬁ", "Ünïcödé", "é", " ", "x" * 40]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    return texts + [None, "", " ", "▁", "<|endoftext|> <s> </s> <unk>", "<0x41>", "a\0b", "the end", "the end", "퟿￿",
                    "ascii only text " * 30]


@pytest.mark.parametrize("p", [Counting(), Counting(parts=3, shares=2, spill_records=50, fan_in=2)])
def test_cross_tokens_equal_brute_force(spark, tokenizer_files, p):
    texts = align_texts()
    want, holders, top = brute_align(texts, tokenizer_files)
    df = spark.createDataFrame([(i if i != 5 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, N_A int").repartition(3)
    found = CrossTokens(df, *tokenizer_files, p)
    got = {r[0]: r[1:] for r in rows_of(found.documents())}
    assert got == {i if i != 5 else None: w for i, w in enumerate(want)}
    assert sum(w[3] > 0 for w in want) > 40 and sum(w[3] == 0 for w in want) >= 3
    assert {(a, b): (n, best) for a, b, n, best in rows_of(found.pairs())} == \
        {(a, b): (n, n == top[a]) for (a, b), n in holders.items()}


def test_cross_token_groups_of_repeated_rows_and_empty_tables(spark, tokenizer_files):
    df = spark.createDataFrame([(1, "the end"), (1, "the end"), (2, None)], "doc_id long, text string")
    found = CrossTokens(df, *tokenizer_files)
    rows = rows_of(found.groups())
    assert rows[0] == rows[1] and rows[2] == (2, [], [], [], [])
    _, a, b, ga, gb = rows[0]
    assert ga == sorted(ga) and gb == sorted(gb) and set(ga) == set(gb) and len(a) == len(ga) and len(b) == len(gb)
    assert {n for _, _, n, _ in rows_of(found.pairs())} == {2}
    none = CrossTokens(df.limit(0), *tokenizer_files)
    assert rows_of(none.documents()) == [] and rows_of(none.pairs()) == []


def test_runs_merge_and_round_trip():
    rng = random.Random(4)
    runs, total = [], Counter()
    for _ in range(9):
        pairs = sorted(rng.sample(range(1 << 36), 40) + rng.sample(range(50), 20))
        counts = [rng.randrange(1, 1 << rng.randrange(1, 33)) for _ in pairs]
        total.update(dict(zip(pairs, counts)))
        runs.append(crosstok.pack(np.diff(np.array(pairs), prepend=0), np.array(counts)))
    steps, counts = crosstok.unpack(crosstok.merge_runs(runs), 2)
    assert dict(zip(np.cumsum(steps).tolist(), counts.tolist())) == dict(total)
    code = crosstok.PairCode(50257, 32000, 64)
    a, b = np.array([0, 63, 64, 50256]), np.array([31999, 0, 5, 31999])
    assert code.first_id(code.of(a, b)).tolist() == a.tolist() and code.second_id(code.of(a, b)).tolist() == b.tolist()


# --- sharding ----------------------------------------------------------------------------------------

def brute_shards(rows, shards):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, at, slots, out = sum(r[1] for r in rows), 0, Counter(), []
    for r in rows:
        s = min(shards - 1, (2 * at + r[1]) * shards // (2 * total))
        out.append((*r, s, slots[s]))
        slots[s] += 1
        at += r[1]
    return out


def test_shards_equal_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, "z" * rng.randrange(300)) for i in range(500)] + [(None, "n"), (None, None), (600, None), (601, ""), (602, "é" * 9000)]
    docs += [(33, f"copy {i % 7}") for i in range(250)]          # one id on a third of the rows
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, Slot int").repartition(4)
    got = sharding.shard(df, sharding.Sharding(shards=13))
    key = lambda r: (r[3], r[4])
    thin = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs]
    assert sorted(rows_of(got), key=key) == brute_shards(thin, 13)
    found = {r["shard"]: r for r in sharding.manifest(got).collect()}
    target = sum(r[1] for r in thin) / 13
    assert all(abs(found[s]["bytes"] - target) <= 18016 for s in found)
    assert rows_of(sharding.shard(df.limit(0))) == []


def test_written_shards_hold_whole_rows_in_slot_order(spark, tmp_path):
    docs = [(i, f"text {i} " * (i % 9), "a") for i in range(200)] + [(5, "text", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string").repartition(3)
    made = sharding.write_shards(df, str(tmp_path / "out"), sharding.Sharding(shards=5))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, rows_of(back.select("doc_id", "text", "shard")))) == sorted(map(repr, docs))
    slots = defaultdict(list)
    for s, slot in rows_of(back.select("_shard", "slot")):
        slots[s].append(slot)
    assert {s: sorted(x) for s, x in slots.items()} == {r["shard"]: list(range(r["rows"])) for r in made.collect()}


def test_both_byte_level_engines_give_the_same_ids(tokenizer_files):
    """Every code point beside letters, digits, contractions and white space; tokens of the vocabulary at random."""
    one = crosstok.ByteLevel(tokenizer_files[0])
    assert one.fast is not None
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}'ve{c}1 {c}{c} {c}'ve.{c}\n{c}" for c in chars]
    rng = random.Random(0)
    pieces = [p for p in one.pieces.to_pylist() if len(p) > 1]
    texts += [b"".join(rng.choice(pieces)[:rng.randrange(1, 6)] for _ in range(rng.randrange(2, 8))).decode("utf-8", "ignore")
              for _ in range(20_000)]
    for lo in range(0, len(texts), 50_000):
        part = [" " + t for t in texts[lo:lo + 50_000]]
        slow = [e.ids for e in one.model.encode_batch_fast(part, add_special_tokens=False)]
        assert [one.fast.encode_ordinary(t) for t in part] == slow
