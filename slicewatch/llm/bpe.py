"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become an array of classes. A small automaton says where a pre-token starts; its transition
functions are composed with an associative table (the transition monoid), so the state before every
code point comes from a blocked prefix scan over arrays, without a regular expression. The slices
between boundaries feed pair merging through a bounded cache. Token offsets are kept and decoding
writes every token at its offset.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.llm.common import ship_package, text_blocks

# Classes of code points. An apostrophe before s, t, m, d or before re, ve, ll may open a contraction;
# the last white space before other text is apart from the rest of its run.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK_LAST, SPACE_LAST = range(8)
N_CLASS = 8
# States: what the code points read so far of the current pre-token are.
(AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_BLANK, AFTER_SPACE, ONE_TO_GO, TWO_TO_GO,
 CONTRACTED) = range(10)
N_STATE = 10


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, whether the code point starts a pre-token)."""
    if cls == LETTER:
        if state in (ONE_TO_GO, TWO_TO_GO):
            return (CONTRACTED if state == ONE_TO_GO else ONE_TO_GO), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if cls == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if cls in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, AFTER_BLANK):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_TO_GO, LONG: TWO_TO_GO}[cls], True
    if cls == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (AFTER_BLANK if cls == BLANK_LAST else AFTER_SPACE), True


@functools.cache
def _automaton():
    """(next state, boundary) by ``class * N_STATE + state``; (composition, application) tables of the
    transition monoid. Classes from N_CLASS on are those of a text's first code point: any state before
    counts as the start, so one stream can hold many texts."""
    nxt = np.zeros((2 * N_CLASS, N_STATE), np.uint8)
    cut = np.zeros((2 * N_CLASS, N_STATE), bool)
    for c in range(N_CLASS):
        for s in range(N_STATE):
            nxt[c, s], cut[c, s] = _step(s, c)
            nxt[c + N_CLASS, s], cut[c + N_CLASS, s] = _step(AT_START, c)
    known = {tuple(range(N_STATE)): 0}
    order, i = [tuple(range(N_STATE))], 0
    while i < len(order):
        for c in range(2 * N_CLASS):
            f = tuple(int(nxt[c, s]) for s in order[i])
            if f not in known:
                known[f] = len(order)
                order.append(f)
        i += 1
    apply = np.array(order, np.uint8)
    compose = np.array([[known[tuple(int(g[s]) for s in f)] for g in order] for f in order], np.uint16)
    letter = np.array([known[tuple(int(x) for x in nxt[c])] for c in range(2 * N_CLASS)], np.uint16)
    return nxt.ravel(), cut.ravel(), compose, apply, letter


def _members(pattern: str) -> np.ndarray:
    """All code points that the tokenizer library's pattern engine counts to a class of one character: an encoder over
    single bytes gives back the bytes that its pattern matches, and skips the others."""
    import tiktoken
    engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    chars = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")
    return np.frombuffer(bytes(engine.encode_ordinary(chars)).decode("utf-8").encode("utf-32-le"), "<u4")


@functools.cache
def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        table[_members(pattern)] = kind
    return table


def _classes(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each code point; ``first``: indexes where a text starts."""
    cls = _class_table()[cps]
    n = len(cps)
    start = np.zeros(n + 2, bool)
    start[first] = True
    start[n:] = True
    space = cls == SPACE
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~start[1:n + 1]
    cls[last] = np.where(cps[last] == 0x20, BLANK_LAST, SPACE_LAST)
    at = np.flatnonzero(cps == 0x27)
    at = at[~start[at + 1]]
    one = cps[at + 1]
    cls[at[np.isin(one, [0x73, 0x74, 0x6D, 0x64])]] = SHORT
    at, one = at[~start[at + 2]], one[~start[at + 2]]
    two = cps[at + 2]
    cls[at[((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C))]] = LONG
    cls[first] += N_CLASS
    return cls


def _states_before(fn: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each element of a sequence of transition functions: exclusive prefix composition,
    applied to the start state. Rows of ``width`` are composed side by side, row totals recursively."""
    _, _, compose, apply, _ = _automaton()
    n = len(fn)
    if n <= width:
        out, s = np.zeros(n, np.uint8), AT_START
        for i in range(n):
            out[i] = s
            s = apply[fn[i], s]
        return out
    rows = -(-n // width)
    cols = np.zeros(rows * width, np.uint16)
    cols[:n] = fn
    cols = np.ascontiguousarray(cols.reshape(rows, width).T)
    flat, size = compose.ravel(), compose.shape[1]
    total = cols[0]
    for c in range(1, width):
        total = flat[total.astype(np.int32) * size + cols[c]]
    s = _states_before(total, width)
    out = np.empty((width, rows), np.uint8)
    shift, flat = apply.shape[1], apply.ravel()
    for c in range(width):
        out[c] = s
        s = flat[cols[c].astype(np.int32) * shift + s]
    return np.ascontiguousarray(out.T).ravel()[:n]


def pre_tokens(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the code points that start a pre-token; ``first`` as in ``_classes``."""
    if not len(cps):
        return np.zeros(0, np.int64)
    _, cut, _, _, letter = _automaton()
    cls = _classes(cps, first)
    state = _states_before(letter[cls])
    return np.flatnonzero(cut[cls.astype(np.int32) * N_STATE + state])


#: Rank of a pair that does not merge.
_NONE = 1 << 60


class Vocabulary:
    """Merge ranks of a rank file; encodes one pre-token at a time, decodes ids with their offsets."""

    #: Pre-tokens kept per generation of the cache; two generations are held.
    CACHE = 100_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _miss(self, piece: bytes) -> bytes:
        """Ids (packed int32) of a pre-token that the young generation does not hold."""
        found = self.old.get(piece)
        if found is None:
            whole = self.rank.get(piece)
            ids = self._merge(piece) if whole is None else [whole]
            found = np.array(ids, np.int32).tobytes() if len(ids) > 8 else struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= 256:
            if len(self.young) >= self.CACHE:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        if len(piece) > 96:
            return self._merge_long(piece)
        get, edges = self.rank.get, list(range(len(piece) + 1))
        ranks = [get(piece[i:i + 2], _NONE) for i in range(len(piece) - 1)]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            del edges[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(piece[edges[i]:edges[i + 2]], _NONE)
            if i:
                ranks[i - 1] = get(piece[edges[i - 1]:edges[i + 1]], _NONE)
        return [self.rank[piece[x:y]] for x, y in zip(edges, edges[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over linked parts: n log n for very long pre-tokens."""
        n = len(piece)
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.rank.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := self.rank.get(piece[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := self.rank.get(piece[prev[i]:stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return [self.rank[piece[i:end[i]]] for i in range(n) if alive[i]]

    def encode_block(self, block):
        """(ids, byte offset of each token inside its text, tokens per text) of a text block."""
        raw = block.buf.tobytes()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # not valid UTF-8: each text is read with replacement characters
            fixed = pa.array([block.text_bytes(i).decode("utf-8", "replace") for i in range(len(block))])
            parts = [self.encode_block(b) for b in text_blocks(fixed, 1 << 60)]
            return parts[0]
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((block.buf & 0xC0) != 0x80)  # byte position of each code point
        full = block.ends > block.starts
        cut = at[pre_tokens(cps, np.searchsorted(at, block.starts[full]))]
        edges = cut.tolist() + [len(raw)]
        miss = self._miss
        found = [self.young.get(piece) or miss(piece) for piece in [raw[s:e] for s, e in zip(edges, edges[1:])]]
        ids = np.frombuffer(b"".join(found), np.int32)
        ends = np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, np.int64)
        begin = ends - self.lengths[ids]
        text_of = np.searchsorted(block.ends, begin, side="right")
        counts = np.bincount(text_of, minlength=len(block)) if len(ids) else np.zeros(len(block), np.int64)
        return ids, (begin - block.starts[text_of]).astype(np.int32), counts

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, each written at its offset."""
        if not len(ids):
            return b""
        lens = self.lengths[ids]
        out = np.zeros(int((offsets + lens).max()), np.uint8)
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(offsets, lens) + inner] = self.bytes[np.repeat(self.starts[ids], lens) + inner]
        return out.tobytes()


@functools.cache
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(SparkFiles.get(name))


def ship_vocabulary(spark, path: str) -> str:
    """Send the rank file (of fixed size) to every executor once; the name tasks open it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, rank_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids array<int>, offsets array<int>`` (byte offset where each token
    starts). Whole texts, no special tokens: control strings are ordinary text. Null and empty texts have
    no tokens; bytes that are no UTF-8 count as replacement characters; repeated rows and null ids are
    encoded like any other; an empty table gives an empty result; other columns are not read."""
    ship_package(docs.sparkSession)
    name = ship_vocabulary(docs.sparkSession, rank_file)

    def run(batches):
        vocabulary = _vocabulary(name)
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                ids, offsets, counts = vocabulary.encode_block(block)
                edge = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.ListArray.from_arrays(edge, pa.array(ids)),
                     pa.ListArray.from_arrays(edge, pa.array(offsets))], names=["doc_id", "ids", "offsets"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, rank_file: str, keep_ids: bool = False) -> DataFrame:
    """``tokens`` (with ``ids`` and ``offsets`` as ``encode`` gives them) with a binary column ``decoded``
    in place of the two (``keep_ids``: of the offsets only); all other columns pass through."""
    ship_package(tokens.sparkSession)
    name = ship_vocabulary(tokens.sparkSession, rank_file)
    kept = [f for f in tokens.schema.fields if f.name not in ("ids", "offsets", "decoded")]
    names = [f.name for f in kept] + ["ids"] * keep_ids
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids array<int>"] * keep_ids + ["decoded binary"])

    def run(batches):
        vocabulary = _vocabulary(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [vocabulary.decode(i.values.to_numpy(), o.values.to_numpy()) if i.is_valid else b""
                       for i, o in zip(part.column("ids"), part.column("offsets"))]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(out, pa.binary())],
                                                 names=[*names, "decoded"])
    return tokens.select(*[f.name for f in kept], "ids", "offsets").mapInArrow(run, schema)
