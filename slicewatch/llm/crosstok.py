"""Alignment of two tokenizers' tokens, and corpus-wide counts of the id pairs that overlap.

Both tokenizers cut the same bytes. Where tokens of both end at one byte offset, a group ends; inside a group every
two tokens whose byte ranges overlap are a link. A pair's count is the number of documents that hold it linked.

The counting is external, in rounds of Spark tasks over one written table:

1. A task tokenizes and aligns its texts and collects pair-document records. A full buffer is a *spill*: the
   records are radix-partitioned by the first tokenizer's id (its low digit), sorted side-major (first id, second id,
   document) and written as zstd runs, one row per (block, part). The pairs and their numbers of documents lie
   beside the records, which never leave the table for the counting.
2. Per (part, share of the blocks) the runs of pairs meet in a k-way heap merge that adds up equal pairs, a bounded
   number of runs at a time; per part the shares meet in one more merge. Its side-major order brings all
   partners of a first id one after the other, so the id's highest count is known when its last partner has passed.
   What is merged is one entry per block and pair, so a pair that all documents hold costs no more than others.
3. The counts stream back: each block's pairs pick theirs from their part, and each block's records add them up per
   document.

A part's merged pairs are bounded by the vocabularies (its first ids times the second vocabulary), whatever the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, ship_package, text_blocks

#: Bits of a document's place inside its block.
DOC_BITS = 20


@dataclass(frozen=True)
class Counting:
    parts: int = 64                  # radix of the first tokenizer's id
    shares: int = 8                  # merge tasks per part before the last merge
    spill_records: int = 1 << 20     # records of a block (a document is never split)
    fan_in: int = 64                 # runs merged at a time


# --- tokenizers ------------------------------------------------------------------------------------

def _byte_of_char() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in zip(plain + [256 + i for i in range(len(rest))], plain + rest)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library, without special tokens.

    Where the file says no more than the public byte-level scheme (its pattern, no normaliser, every merge ranked
    by the id of what it makes), the same ids come four times faster from the tiktoken library with the file's
    vocabulary as ranks; tests hold both against each other on every code point. Texts that this engine
    refuses, and all texts under other files, go through the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # Spark deals the texts to the cores
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        to_byte = _byte_of_char()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = self.model.get_vocab()
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = piece.encode("utf-8") if i in special else bytes(to_byte[c] for c in piece)
        self.pieces = pa.array(pieces, pa.binary())
        self.fast = self._ranked(spec, {p: i for i, p in enumerate(pieces) if i not in special and p})

    @staticmethod
    def _ranked(spec: dict, ranks: dict[bytes, int]):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        first = 256
        plain = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
                 and not before.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                 and all(model["vocab"].get(m) == first + i for i, m in enumerate(made)) and len(ranks) == first + len(made))
        if not plain:
            return None
        import tiktoken
        from public_tokenizers import PATTERN
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        out = []
        for t in texts:
            try:
                ids = self.fast and self.fast.encode_ordinary(" " + t)
            except BaseException as e:      # the engine's own panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
                ids = None
            out.append(ids if ids is not None else self.model.encode(" " + t, add_special_tokens=False).ids)
        return out


class Pieces:
    """A sentencepiece model; it adds the leading space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        n = len(self.model)
        self.pieces = pa.array(
            [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i)
             else self.model.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(n)], pa.binary())

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


@functools.cache
def _tokenizer(name: str):
    path = SparkFiles.get(name)
    return Pieces(path) if name.endswith(".model") else ByteLevel(path)


class Tokens:
    """Ids of several texts one after the other, with the bytes they stand for."""

    def __init__(self, tokenizer, texts: list[str]):
        ids = tokenizer.encode(texts)
        self.counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in ids]) if ids else np.zeros(0, np.int64)
        joined = tokenizer.pieces.take(pa.array(self.ids))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int32)[1:len(self.ids) + 1].astype(np.int64)
        self.lengths = np.diff(ends, prepend=0)
        self.data = data.to_pybytes() if data is not None else b""
        upto = np.concatenate([[0], np.cumsum(self.counts)])
        at = np.concatenate([[0], ends])
        self.text_starts = at[upto]

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.text_starts[i]:self.text_starts[i + 1]]

    def keep(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end offset of each) of the chosen texts, put one after the other."""
        mask = np.repeat(good, self.counts)
        return self.ids[mask], np.cumsum(self.lengths[mask])


# --- alignment of a block of texts -----------------------------------------------------------------

@dataclass
class Aligned:
    """Alignment of the texts of one block. Per text (n of them; zeros where it has no tokens): n_a, n_b, n_groups,
    n_links. Over the texts with tokens, one after the other: ids and, per token, its group; per link the two
    token indices and the text's index in the block."""

    per_text: np.ndarray             # (4, n)
    used: np.ndarray                 # indices of the texts that have tokens
    ids: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    link: tuple[np.ndarray, np.ndarray, np.ndarray]


def align_block(block, one, two) -> Aligned:
    n = len(block)
    per_text = np.zeros((4, n), np.int64)
    raw = [block.text_bytes(i) for i in range(n)]
    some = [i for i in range(n) if raw[i]]
    texts = [raw[i].decode("utf-8", "replace") for i in some]     # bytes that are no UTF-8 differ below
    a, b = Tokens(one, texts), Tokens(two, texts)
    good = np.array([a.bytes_of(k) == b.bytes_of(k) == b" " + raw[i] for k, i in enumerate(some)], bool)
    used = np.array(some, np.int64)[good] if some else np.zeros(0, np.int64)
    (ids_a, ends_a), (ids_b, ends_b) = a.keep(good), b.keep(good)
    size = int(ends_a[-1]) if len(ends_a) else 0
    cut = np.zeros((2, size), bool)                               # the byte that a token ends on
    cut[0, ends_a - 1] = True
    cut[1, ends_b - 1] = True
    seen = np.cumsum(cut, axis=1, dtype=np.int64)                 # tokens ended up to a byte, it included
    both, either = cut[0] & cut[1], cut[0] | cut[1]
    groups = np.cumsum(both)
    last = np.cumsum(np.array([len(raw[i]) + 1 for i in used], np.int64)) - 1
    for row, total in enumerate((seen[0], seen[1], groups, np.cumsum(either))):
        per_text[row, used] = np.diff(total[last], prepend=0)
    at = np.flatnonzero(either)                                   # every stretch between cuts is one link
    link = (seen[0][at] - cut[0][at], seen[1][at] - cut[1][at], used[np.searchsorted(last, at)])
    group = (groups[ends_a - 1] - 1 + ~both[ends_a - 1], groups[ends_b - 1] - 1 + ~both[ends_b - 1])
    return Aligned(per_text, used, (ids_a, ids_b), group, link)


class GroupText:
    """Groups as text, ``a1,a2|b1;a3|b2,b3``, put together without a Python loop over tokens."""

    def __init__(self, size_a: int, size_b: int):
        self.seps = (b",", b"|", b";", b"")
        ids = [str(i).encode() for i in range(max(size_a, size_b))]
        self.table = np.array([[i + s for i in ids] for s in self.seps])

    def of(self, x: Aligned):
        """(text index, groups as bytes) of every text with tokens."""
        (ids_a, ids_b), (ga, gb) = x.ids, x.group
        n_groups = int(x.per_text[2].sum())
        upto_a = np.cumsum(np.bincount(ga, minlength=n_groups))
        upto_b = np.cumsum(np.bincount(gb, minlength=n_groups))
        i, j = np.arange(len(ga)), np.arange(len(gb))
        out = np.empty(len(ga) + len(gb), self.table.dtype)
        before_b = np.concatenate([[0], upto_b[:-1]]) if n_groups else upto_b
        out[i + before_b[ga]] = self.table[(i + 1 == upto_a[ga]).astype(np.int64), ids_a]
        ends_text = np.zeros(n_groups, bool)
        ends_text[np.cumsum(x.per_text[2, x.used]) - 1] = True
        out[j + upto_a[gb]] = self.table[np.where(j + 1 < upto_b[gb], 0, np.where(ends_text[gb], 3, 2)), ids_b]
        edges = np.concatenate([[0], np.cumsum(x.per_text[0, x.used] + x.per_text[1, x.used])])
        for k, text in enumerate(x.used):
            yield text, out[edges[k]:edges[k + 1]].tobytes().translate(None, b"\0")


# --- zstd runs -------------------------------------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, equally long, as byte planes under zstd."""
    head, body = [len(columns[0]) if columns else 0], []
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<i8")
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        head.append(width)
        body.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return np.array(head, "<i4").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    head = np.frombuffer(data, "<i4", columns + 1)
    n = int(head[0])
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 * (columns + 1):]), np.uint8)
    out, at = [], 0
    for width in head[1:]:
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = body[at:at + n * width].reshape(width, n).T
        out.append(c.reshape(-1).view("<i8"))
        at += n * int(width)
    return out


def _deltas(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=0)


class PairCode:
    """Pairs as integers whose order is part, then first id, then second id."""

    def __init__(self, size_a: int, size_b: int, parts: int):
        self.size_b, self.parts = size_b, parts
        self.width = -(-size_a // parts) * size_b
        if (self.width * parts) >> (63 - DOC_BITS):
            raise ValueError("the vocabularies are too large for 64-bit records")

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a % self.parts) * self.width + (a // self.parts) * self.size_b + b

    def first_id(self, code: np.ndarray) -> np.ndarray:
        return (code % self.width) // self.size_b * self.parts + code // self.width

    def second_id(self, code: np.ndarray) -> np.ndarray:
        return code % self.width % self.size_b


BLOCKS = "block long, part int, keys binary, records binary"
STATS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _spill(block: int, stats: list[pa.RecordBatch], records: list[np.ndarray], code: PairCode):
    """The rows of one block: part -1 holds the documents' own figures, every other part its sorted run."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STATS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for batch in stats:
            w.write_batch(batch)
    rows = [(block, -1, None, sink.getvalue().to_pybytes())]
    r = np.sort(np.concatenate(records)) if records else np.zeros(0, np.int64)
    if len(r):
        first = np.flatnonzero(np.diff(r, prepend=-1))
        times, r = np.diff(first, append=len(r)), r[first]         # how often a document holds the pair
        pair, doc = r >> DOC_BITS, r & ((1 << DOC_BITS) - 1)
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        pairs, docs = pair[new], np.diff(new, append=len(pair))
        step = np.diff(doc, prepend=0)
        step[new] = doc[new]
        part = pairs // code.width
        edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
        for lo, hi in zip(edges, edges[1:]):
            x, y = new[lo], new[hi] if hi < len(new) else len(pair)
            rows.append((block, int(part[lo]), pack(_deltas(pairs[lo:hi]), docs[lo:hi]), pack(step[x:y], times[x:y])))
    cols = list(zip(*rows))
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                      pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                     names=["block", "part", "keys", "records"])


def _collect(name_a: str, name_b: str, p: Counting):
    def run(batches):
        one, two = _tokenizer(name_a), _tokenizer(name_b)
        code = PairCode(len(one.pieces), len(two.pieces), p.parts)
        text = GroupText(len(one.pieces), len(two.pieces))
        block, stats, records, held, docs = TaskContext.get().partitionId() << 24, [], [], 0, 0
        for batch in batches:
            for part in text_blocks(batch.column(1)):
                x = align_block(part, one, two)
                digest = [""] * len(part)
                for i, groups in text.of(x):
                    digest[i] = hashlib.sha256(groups).hexdigest()
                ids = batch.column(0).slice(part.first, len(part))
                stats.append(pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in x.per_text), pa.array(digest)], schema=STATS))
                ia, ib, at = x.link
                records.append(code.of(x.ids[0][ia], x.ids[1][ib]) << DOC_BITS | (docs + at))
                held += len(at)
                docs += len(part)
                if held >= p.spill_records or docs >= 1 << (DOC_BITS - 1):
                    yield from _spill(block, stats, records, code)
                    block, stats, records, held, docs = block + 1, [], [], 0, 0
        if stats:
            yield from _spill(block, stats, records, code)
    return run


# --- counting --------------------------------------------------------------------------------------

def merge_runs(runs: list[bytes]) -> bytes:
    """One run out of several: a heap holds the next pair of each, equal pairs add up."""
    def entries(run: bytes):
        steps, n = unpack(run, 2)
        return zip(np.cumsum(steps).tolist(), n.tolist())
    pairs, counts = [], []
    for pair, n in heapq.merge(*map(entries, runs)):
        if pairs and pairs[-1] == pair:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
    return pack(_deltas(np.array(pairs, np.int64)), np.array(counts, np.int64))


def _merge_all(batches, fan_in: int) -> bytes:
    """All runs of a group, ``fan_in`` in memory at a time."""
    held: list[bytes] = []
    for batch in batches:
        for run in batch.column("keys"):
            held.append(run.as_py())
            if len(held) >= fan_in:
                held = [merge_runs(held)]
    return merge_runs(held)


def _merge_share(fan_in: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([_merge_all(batches, fan_in)], pa.binary())], names=["part", "keys"])
    return run


def _merge_part(fan_in: int, size_b: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, counts = unpack(_merge_all(batches, fan_in), 2)
        first = np.cumsum(steps) // size_b                        # all partners of a first id lie side by side
        start = np.flatnonzero(np.diff(first, prepend=-1))
        highest = np.maximum.reduceat(counts, start)
        best = counts == np.repeat(highest, np.diff(start, append=len(counts)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(steps, counts, best)], pa.binary())],
                                         names=["part", "merged"])
    return run


def _pick(batches):
    """Rows by part, the merged pairs before the blocks' pairs: each block's pairs get their counts."""
    codes = counts = best = None
    for batch in batches:
        blocks, parts, picked = [], [], []
        for block, part, merged, keys in zip(*(batch.column(c) for c in ("block", "part", "merged", "keys"))):
            if merged.is_valid:
                steps, counts, best = unpack(merged.as_py(), 3)
                codes = np.cumsum(steps)
                continue
            steps, docs = unpack(keys.as_py(), 2)
            at = np.searchsorted(codes, np.cumsum(steps))
            blocks.append(block.as_py())
            parts.append(part.as_py())
            picked.append(pack(docs, counts[at], best[at]))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(picked, pa.binary())],
                                         names=["block", "part", "picked"])


def _add_up(batches):
    """Rows by block and part, records before counts: sums per document, given out when the block ends."""
    now, table, best, total, held = None, None, None, None, None

    def done():
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in STATS.names), pa.array(best), pa.array(total)],
                                          names=[*STATS.names, "n_best", "count_sum"])
    for batch in batches:
        for block, part, records, picked in zip(*(batch.column(c) for c in ("block", "part", "records", "picked"))):
            if block.as_py() != now:
                if table is not None:
                    yield done()
                now, table = block.as_py(), pa.ipc.open_stream(records.as_py()).read_all()
                best, total = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
            elif records.is_valid:
                held = records.as_py()
            else:
                docs, counts, is_best = unpack(picked.as_py(), 3)
                step, times = unpack(held, 2)
                start = np.cumsum(docs) - docs
                run = np.cumsum(step)
                doc = run - np.repeat(run[start] - step[start], docs)
                np.add.at(total, doc, np.repeat(counts, docs) * times)
                np.add.at(best, doc, np.repeat(is_best, docs) * times)
    if table is not None:
        yield done()


# --- the operator ----------------------------------------------------------------------------------

class CrossTokens:
    """Alignment of ``docs`` under two tokenizer files (first: byte-level BPE of the tokenizers library, second: a
    sentencepiece model). Space plus text is tokenized whole, without special tokens.

    Every row is a document of its own, so repeated ids count each. Texts null, empty, not UTF-8, or whose joined
    token bytes of either side differ from space plus text have no tokens: zeros and an empty digest. An
    empty table gives empty results. Columns other than the two named are not read.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, p: Counting = Counting(), doc_id: str = "doc_id", text: str = "text"):
        self.spark, self.p = docs.sparkSession, p
        ship_package(self.spark)
        for path in (path_a, path_b):
            self.spark.sparkContext.addFile(path)        # files of fixed size, once per executor
        self.names = tuple(path.rsplit("/", 1)[-1] for path in (path_a, path_b))
        sizes = [len((Pieces if path.endswith(".model") else ByteLevel)(path).pieces) for path in (path_a, path_b)]
        self.code = PairCode(*sizes, p.parts)
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def groups(self) -> DataFrame:
        """The alignment itself: ``doc_id, a_ids, b_ids, a_groups, b_groups`` (group number of each token)."""
        names = self.names

        def run(batches):
            one, two = _tokenizer(names[0]), _tokenizer(names[1])
            for batch in batches:
                for part in text_blocks(batch.column(1)):
                    x = align_block(part, one, two)
                    base = np.cumsum(x.per_text[2]) - x.per_text[2]
                    cols = []
                    for values in (x.ids, x.group):
                        for side in (0, 1):
                            n = x.per_text[side]
                            v = values[side] - (np.repeat(base, n) if values is x.group else 0)
                            edge = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                            cols.append(pa.ListArray.from_arrays(edge, pa.array(v.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), *cols],
                                                     names=["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"])
        return self.docs.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>")

    @functools.cached_property
    def blocks(self) -> DataFrame:
        """The written table of spills."""
        return cut_lineage(self.docs.mapInArrow(_collect(*self.names, self.p), BLOCKS), "spills")

    @functools.cached_property
    def merged(self) -> DataFrame:
        """``part, merged``: one row per part with all its pairs, their counts and whether each is its first id's best."""
        p = self.p
        runs = self.blocks.filter("part >= 0").select("part", "keys", F.pmod(F.xxhash64("block"), F.lit(p.shares)).alias("share"))
        shares = runs.groupBy("part", "share").applyInArrow(_merge_share(p.fan_in), "part int, keys binary")
        return cut_lineage(shares.groupBy("part").applyInArrow(_merge_part(p.fan_in, self.code.size_b), "part int, merged binary"), "pairs")

    def pairs(self) -> DataFrame:
        """``a_id, b_id, documents, best``: every linked pair of ids, its number of documents, and whether no other
        partner of a_id has more."""
        code = self.code

        def run(batches):
            for batch in batches:
                for merged in batch.column("merged"):
                    steps, counts, best = unpack(merged.as_py(), 3)
                    c = np.cumsum(steps)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code.first_id(c)), pa.array(code.second_id(c)), pa.array(counts), pa.array(best.astype(bool))],
                        names=["a_id", "b_id", "documents", "best"])
        return self.merged.select("merged").mapInArrow(run, "a_id long, b_id long, documents long, best boolean")

    def documents(self) -> DataFrame:
        """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``."""
        share = F.pmod(F.xxhash64("block"), F.lit(self.p.shares))
        none, empty = F.lit(None).cast("long"), F.lit(None).cast("binary")
        copies = self.merged.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.p.shares - 1).cast("long"))))
        asked = self.blocks.filter("part >= 0").select("block", "part", share.alias("share"), empty.alias("merged"), "keys")
        told = copies.select(none.alias("block"), "part", "share", "merged", empty.alias("keys"))
        picked = (told.unionByName(asked).repartition("part", "share")
                  .sortWithinPartitions("part", "share", F.col("merged").isNull())
                  .mapInArrow(_pick, "block long, part int, picked binary"))
        rows = self.blocks.select("block", "part", "records", empty.alias("picked")).unionByName(
            picked.select("block", "part", empty.alias("records"), "picked"))
        fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
        return (rows.repartition("block").sortWithinPartitions("block", "part", F.col("records").isNull())
                .mapInArrow(_add_up, fields))
