"""Windows of the quality features are characters in every script."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from slicewatch.llm import quality
from slicewatch.llm.common import text_blocks


def test_character_windows_equal_brute_force():
    texts = ["привет мир", "漢字かな交じり文", "plain words", "añb 😀x é", "", None, "é"]
    p = quality.Subwords()
    block = next(text_blocks(pa.array(texts)))
    assert [chr(c) for c in quality._code_points(block.buf, np.flatnonzero((block.buf & 0xC0) != 0x80))] == list("".join(t or "" for t in texts))
    windows = [(k, i, t[j:j + k]) for k in p.orders for i, t in enumerate(x or "" for x in texts) for j in range(len(t) - k + 1)
               if " " not in t[j + 1:j + k - 1]]
    groups = list(quality.features(block, p))[-len(p.orders):]
    got = [(k, int(d), int(b)) for k, (bucket, doc) in zip(p.orders, groups) for b, d in zip(bucket, doc)]
    assert [(k, i) for k, i, _ in got] == [(k, i) for k, i, _ in windows]
    names = {}
    assert all(names.setdefault((k, w), b) == b for (k, _, w), (_, _, b) in zip(windows, got))
    assert len(set(names.values())) == len(names)
