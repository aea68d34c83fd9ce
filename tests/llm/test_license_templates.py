"""Licence matches are maximal per template, not over all templates together."""

from __future__ import annotations

import random

import pyarrow as pa

from slicewatch.llm import licenses
from slicewatch.llm.common import text_blocks


def test_template_matches_equal_brute_force():
    rng = random.Random(12)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(8)]
    automaton = licenses.SuffixAutomaton(sequences)
    for _ in range(200):
        text = [rng.randint(0, 4) for _ in range(30)]
        want = set()
        for k, s in enumerate(sequences):
            for b in range(30):
                for a in range(len(s)):
                    if b and a and text[b - 1] == s[a - 1]:
                        continue
                    n = 0
                    while b + n < 30 and a + n < len(s) and text[b + n] == s[a + n]:
                        n += 1
                    if n >= 2:
                        want.add((b, n, k, a + n - 1))
        got = automaton.template_matches(text, 2)
        assert len(got) == len(set(got)) and set(got) == want


def test_words_shared_with_a_longer_match_count():
    block = next(text_blocks(pa.array(["Licensed under CC BY-NC-SA 4.0"])))
    covers = {c["label"]: c["cover"] for c in licenses.Scanner(licenses.Scan()).block(block)[2][0]}
    assert covers["cc-by-sa"] == 1.0 and round(covers["cc-by-nc"], 2) == 0.71
