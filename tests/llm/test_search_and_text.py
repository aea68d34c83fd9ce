"""Search, tokenizer, chat, licence and tiling operators against brute force on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slicewatch.llm import bpe, chat, licenses, maxscore, tiling
from slicewatch.llm import words as W
from slicewatch.llm.common import cut_lineage, text_blocks

DOCS = "doc_id long, text string, Text_Len int"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- exact top-k -----------------------------------------------------------------------------------

def brute_top_k(rows, queries, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * x) for x in v]
    out = []
    for q in queries:
        if q in ok:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, query_rows", [(4096, 1024), (40, 7)])
def test_top_k_equals_brute_force(spark, shard_rows, query_rows):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(i, list(rows[5][1])) for i in range(300, 360)]  # copies: ties go to the smaller id
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, rows[0][1]),
             (420, [0.5] * 3), (440, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    p = maxscore.Search(k=5, shard_rows=shard_rows, query_rows=query_rows, warm_rows=8)
    got = sorted(rows_of(maxscore.top_k(df.filter("vec_id % 20 = 0"), df, p)))
    assert got == brute_top_k(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 5)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert rows_of(maxscore.top_k(df.filter("vec_id = 0"), df)) == [(0, 1, 1, 64 * 128)]
    assert rows_of(maxscore.top_k(df.limit(0), df.limit(0))) == []
    assert rows_of(maxscore.top_k(df.limit(0), df)) == []


def test_rows_of_one_id_spread_over_shards(spark):
    rows = spark.range(0, 2000, 1, 4).select(F.lit(7).cast("long").alias("id"), F.array(F.col("id")).alias("v"))
    blocks = maxscore._packed(cut_lineage(rows, "repeats"), 8, "shard", "id").select(F.length("ids") / 8).collect()
    assert len(blocks) == 8 and sum(n for n, in blocks) == 2000
    assert max(n for n, in blocks) < 500


def test_large_components_stay_exact():
    ids, x = np.arange(40), np.array([[10**9 + i, -(10**9)] for i in range(40)])
    _, best, score = next(iter(maxscore.search_shard(ids, x, ids[:1], x[:1], maxscore.Search(k=3, warm_rows=4))))
    assert best.tolist() == [39, 38, 37]
    assert [int(s) for s in score] == [10**9 * (10**9 + i) + 10**18 for i in (39, 38, 37)]


# --- byte-level BPE --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, tokenizer):
    path, library = tokenizer
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "ß", "1", "٣", "!", "\u00a0", "\u2003",
             "<|endoftext|>", "漢", "🙂", "ñ", "Ab", "\r\n", "'S"]
    texts = ["", None, "'", "''s", "don't've 'll", " 's", "x\n", "  ", "a  b", "\n\nfoo", "'re'ver", "'lx", "'r", "a" * 3000, " " * 900 + "x"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    coded = bpe.encode(df, path)
    got = {r["doc_id"]: r for r in coded.collect()}
    plain = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(coded, path).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode_ordinary(t or ""), t
        assert plain[i] == (t or "").encode()
        ends = [o + len(library.decode_single_token_bytes(x)) for o, x in zip(got[i]["offsets"], got[i]["ids"])]
        assert got[i]["offsets"][1:] == ends[:-1]
    assert rows_of(bpe.encode(df.limit(0), path)) == []


def test_scan_equals_step_by_step():
    rng = np.random.default_rng(0)
    nxt, cut, compose, apply, letter = bpe._automaton()
    for n in (1, 63, 64, 65, 5000):
        cls = rng.integers(0, 2 * bpe.N_CLASS, n)
        state, seen = 0, []
        for c in cls:
            seen.append(state)
            state = nxt[c * bpe.N_STATE + state]
        assert bpe._states_before(letter[cls]).tolist() == seen
    for f in range(len(apply)):  # composition is associative with application
        for g in range(len(apply)):
            assert (apply[compose[f, g]] == apply[g][apply[f]]).all()


# --- chat ------------------------------------------------------------------------------------------

def test_chat_round_trip_and_loss(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\b<|", "\\<|im_end|>\n", "", None, "x\n<", "|im_end|>", "\\\\|", "ü<|ñ"]
    rows = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % len(nasty)], 1) for c in range(6) for t in range(c * 3)]
    rows += [(None, 0, "system", "null conversation", 1), (7, None, None, "no turn", 1), (7, 1, "as sistant\n<|", "x", 1),
             (8, 5, "user", "same", 1), (8, 5, "user", "same", 1), (8, 5, "assistant", "tie", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg int")
    got = {r["conv"]: r for r in chat.read_back(chat.chat_transcripts(df)).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault("null" if c is None else str(c), []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(r, t) for _, _, r, t in turns]
        assert got[c]["learned"] == "".join(t for _, _, r, t in turns if r == "assistant")
    assert rows_of(chat.chat_transcripts(df.limit(0))) == []


def test_reply_tree_paths(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> 5 -> 6; 9 alone; 20 and 21 form a cycle; 31 has an unknown parent
    tree = [("a", 1, None, 0), ("a", 2, 1, 5), ("a", 4, 2, 1), ("a", 3, 1, 2), ("a", 5, 3, 2), ("a", 6, 5, 2), ("b", 9, None, None),
            ("c", 20, 21, 1), ("c", 21, 20, 1), ("d", 31, 30, 1)]
    df = spark.createDataFrame([(c, m, p, "user", f"t{m}", s) for c, m, p, s in tree],
                               "conv string, msg long, parent long, role string, text string, score long")
    got = {}
    for conv, branch, depth, _, text in sorted(rows_of(chat.paths(df, branches=2))):
        got.setdefault((conv, branch), []).append(text)
    # both leaves of a score 6: the smaller leaf first
    assert got == {("a", 1): ["t1", "t2", "t4"], ("a", 2): ["t1", "t3", "t5", "t6"], ("b", 1): ["t9"], ("d", 1): ["t31"]}


def test_long_chain_is_walked_whole(spark):
    df = spark.createDataFrame([(1, i, "user", str(i)) for i in range(300)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.chat_transcripts(df)).first()
    assert [t["text"] for t in row["turns"]] == [str(i) for i in range(300)]


# --- licences --------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_license_places_equal_brute_force(spark):
    texts = ["All rights reserved. CC-BY; cc by cc BY", None, "", "General Public License general public licenseé",
             "GNU General\nPublic  License, all rights reserved", "x" * 5000 + " cc by", "Released under the MIT License.", "cc", "by"]
    texts += [texts[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(lower(t))
        want = sorted((label, k) for phrase, label in licenses.PHRASES for k in range(len(words))
                      if words[k:k + len(phrase.split())] == phrase.split())
        assert sorted((p["label"], p["word"]) for p in got[i]["places"]) == want
        assert got[i]["n_words"] == len(words)
    assert [(c["label"], c["cover"]) for c in got[6]["covers"] if c["cover"] >= 0.75] == [("mit", 1.0)]
    assert rows_of(licenses.scan(df.limit(0))) == []


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(8)]
    automaton = licenses.SuffixAutomaton(sequences)
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        text = [rng.randint(0, 4) for _ in range(30)]
        longest = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in inside), default=0) for i in range(30)]
        want = {(i + 1 - n, n) for i, n in enumerate(longest) if n >= 2 and (i == 29 or longest[i + 1] != n + 1)}
        got = automaton.matches(text, 2)
        assert {(b, n) for b, n, _ in got} == want
        for b, n, state in got:
            ends = {(k, e) for k, s in enumerate(sequences) for e in range(len(s)) if s[max(0, e + 1 - n):e + 1] == text[b:b + n]}
            assert set(automaton.ends[state]) == ends


def test_reordered_template_is_not_one_chain(spark):
    half = "licensed under the Apache License, Version 2.0".split()
    df = spark.createDataFrame([(0, " ".join(half[4:] + ["x"] + half[:4]), 1)], DOCS)
    covers = [c for c in licenses.scan(df).first()["covers"] if c["label"] == "apache-2.0"]
    assert covers and max(c["cover"] for c in covers) < 0.75


# --- greedy string tiling --------------------------------------------------------------------------

def brute_tiles(text, pattern, least):
    """Longest common unmarked run first, smallest pattern start then text start on ties."""
    up, ut, found = [False] * len(pattern), [False] * len(text), []
    while True:
        best = None
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while (p + n < len(pattern) and t + n < len(text) and not up[p + n] and not ut[t + n] and pattern[p + n] == text[t + n]):
                    n += 1
                if n >= least and (best is None or (-n, p, t) < best):
                    best = (-n, p, t)
        if best is None:
            return found
        n, p, t = -best[0], best[1], best[2]
        up[p:p + n] = [True] * n
        ut[t:t + n] = [True] * n
        found.append((p, t, n))


def test_tiles_equal_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        pattern = [rng.randint(0, 3) for _ in range(rng.randint(3, 15))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        got = tiling.tiles(np.array(text, np.uint64), np.array(pattern, np.uint64), 3)
        assert got == brute_tiles(text, pattern, min(3, len(pattern)))


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    docs = [(0, f"Before. {item.upper()} after", 1), (1, " ".join(words[6:]) + " -- " + " ".join(words[:6]), 1), (2, " ".join(words[:4]), 1),
            (3, None, 1), (4, "", 1), (None, item, 1), (5, "short item", 1), (6, "Straße ÉTÉ ñandú über alles " + "x " * 5000, 1), (0, "again", 1)]
    bench = [(10, item), (11, item), (12, "short item"), (13, None), (14, ""), (None, item), (15, "STRASSE straße été Ñandú über alles")]
    df = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["contaminated"], r["items"], r["item_id"]) for r in tiling.decontaminate(df, b).collect()), key=str)
    assert got == sorted([(0, True, [10, 11], 10), (0, True, [10, 11], 10), (1, True, [10, 11], 10), (2, False, [], None), (3, False, [], None),
                          (4, False, [], None), (None, True, [10, 11], 10), (5, True, [12], 12), (6, True, [15], 15)], key=str)
    assert rows_of(tiling.decontaminate(df.limit(0), b)) == []
    assert not any(r["contaminated"] for r in tiling.decontaminate(df, b.limit(0)).collect())


# --- words -----------------------------------------------------------------------------------------

def test_words_equal_regular_expressions():
    rng = random.Random(4)
    texts = ["", "Ab\tC ", "ÀÉ x", None] + ["".join(rng.choice("aB 1\n\té\u00a0漢-!") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    seen = {}
    for lut, pattern in ((W.NON_SPACE, r"[^\x20\x09-\x0D]+"), (W.ALNUM, WORD.pattern)):
        got = [[] for _ in texts]
        for block in text_blocks(pa.array(texts, pa.string()), 64):
            buf, s, e, doc = W.spans(block, lut)
            for i, j, d, h in zip(s, e, doc, W.hashes(buf, s, e)):
                word = buf[i:j].tobytes().decode()
                got[block.first + d].append(word)
                assert seen.setdefault(word, h) == h
        assert got == [re.findall(pattern, lower(t)) for t in texts]
    assert len(set(seen.values())) == len(seen)
    assert W.of_word("straße") == W.hashes(np.frombuffer("straße".encode(), np.uint8), np.array([0]), np.array([7]))[0]
    assert hashlib.sha1(b"").hexdigest()  # digests used by the archive tests
