"""Which (transaction, policy) pairs already hold an outcome, whatever day, run or micro-batch stored it.

The index lies beside the run tables of a store, in two tables hash-bucketed by the pair:

* ``outcome_keys``: the pairs (with the version that wrote them);
* ``outcome_filter``: per bucket a Bloom filter, as 64-bit words of set bits. Every version adds words of its own;
  a bucket's filter is the ``bit_or`` of them.

A batch first asks the filters of the buckets its pairs hash to (a join on bucket and word). Only pairs whose bits
are all set may be stored, and only their buckets are opened and compared pair by pair. A batch of new pairs opens
next to none of the history; how long that is and on which days it lies does not matter. A full filter costs opened
buckets, never a wrong answer; ``compact`` writes it anew in the size that the pairs need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.session import cut_lineage
from slicewatch.sources.snapshots import Snapshots, State, Table

KEYS, FILTER = "outcome_keys", "outcome_filter"
PAIR = ["transaction_id", "policy"]
PROBES = 4                    # bits per pair
BITS_PER_PAIR = 16            # at that load about 1 pair in 400 is a false alarm
DEFAULTS = {"buckets": 32, "words": 4096}     # of a new store; words of 64 bits per bucket


def _settings(state: State) -> dict:
    return {**DEFAULTS, **state.notes.get("index", {})}


def _hashed(pairs: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64(*PAIR)
    return pairs.withColumn("_h", h).withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("int"))


def _bits(hashed: DataFrame, words: int) -> DataFrame:
    """One row per probe of each pair: ``word`` and ``bit`` by double hashing."""
    size = words * 64
    step = F.xxhash64(F.col("_h"), F.lit("step"))
    places = F.array(*[F.pmod(F.shiftrightunsigned("_h", 8) + F.shiftrightunsigned(step, 8) * i, F.lit(size)) for i in range(PROBES)])
    exploded = hashed.withColumn("_place", F.explode(F.array_distinct(places)))
    return exploded.withColumn("word", F.shiftright("_place", 6).cast("int")).withColumn("_bit", F.col("_place").cast("int") % 64)


def _filter_rows(hashed: DataFrame, words: int) -> DataFrame:
    bit = F.expr("shiftleft(1L, _bit)")
    return _bits(hashed, words).groupBy("bucket", "word").agg(F.bit_or(bit).alias("bits"))


def _bucket(folder: str) -> int:
    return int(folder.split("/")[-1].split("=")[1])


def stage(store: Snapshots, state: State, version: str, pairs: DataFrame, run_id: str) -> tuple[dict[str, Table], dict]:
    """Stage the pairs that one run executed. A rerun of ``run_id`` replaces what its earlier attempt stored."""
    index = _settings(state)
    hashed = cut_lineage(_hashed(pairs.where(F.col("transaction_id").isNotNull() & F.col("policy").isNotNull())
                                 .select(*PAIR).distinct(), index["buckets"]), "index")
    runs, dropped = dict(index.get("runs", {})), list(index.get("dropped", []))
    if run_id in runs:
        dropped.append(runs[run_id])
    runs[run_id] = version
    keys = hashed.select(*PAIR, F.lit(version).alias("written"), "bucket").repartition("bucket")
    new = {KEYS: store.stage(KEYS, keys, version, ("bucket",)),
           FILTER: store.stage(FILTER, _filter_rows(hashed, index["words"]).repartition("bucket"), version, ("bucket",))}
    whole = {name: Table(tuple(sorted({*state.tables[name].folders, *t.folders})) if name in state.tables else t.folders, t.schema)
             for name, t in new.items()}
    return whole, {"index": {**index, "runs": runs, "dropped": dropped}}


def known(store: Snapshots, pairs: DataFrame, run_id: str | None = None, state: State | None = None) -> DataFrame | None:
    """The pairs of ``pairs`` that hold a stored outcome of another run than ``run_id``; None without an index.
    Pairs with a null are never known. At most one row per bucket reaches the driver."""
    state = state or store.state()
    if KEYS not in state.tables:
        return None
    index = _settings(state)
    asked = cut_lineage(_hashed(pairs.where(F.col("transaction_id").isNotNull() & F.col("policy").isNotNull())
                                .select(*PAIR).distinct(), index["buckets"]), "asked")
    touched = {r[0] for r in asked.select("bucket").distinct().collect()}
    filters = store.read(FILTER, state, lambda f: _bucket(f) in touched).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    probes = _bits(asked, index["words"])
    hit = F.expr("(shiftrightunsigned(bits, _bit) & 1) = 1")
    maybe = (probes.join(filters, ["bucket", "word"], "left").groupBy("bucket", *PAIR)
             .agg(F.every(F.coalesce(hit, F.lit(False))).alias("_all")).where("_all").select("bucket", *PAIR))
    maybe = cut_lineage(maybe, "maybe")
    opened = {r[0] for r in maybe.select("bucket").distinct().collect()}
    stored = store.read(KEYS, state, lambda f: _bucket(f) in opened)
    left_out = [*index.get("dropped", []), *([index["runs"][run_id]] if run_id in index.get("runs", {}) else [])]
    if left_out:
        stored = stored.where(~F.col("written").isin(left_out))
    return maybe.join(stored.select(*PAIR, "bucket"), ["bucket", *PAIR], "left_semi").select(*PAIR)


def compact(store: Snapshots, state: State | None = None) -> State:
    """Rewrite the index as one version per bucket, with filters sized by the pairs they hold."""
    state = state or store.state()
    if KEYS not in state.tables:
        return state
    index, version = _settings(state), store.version(state)
    stored = store.read(KEYS, state)
    if index.get("dropped"):
        stored = stored.where(~F.col("written").isin(index["dropped"]))
    largest = stored.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    words = 64
    while words * 64 < largest * BITS_PER_PAIR:
        words *= 2
    keys = store.stage(KEYS, stored.repartition("bucket"), version, ("bucket",))
    bits = _filter_rows(stored.withColumn("_h", F.xxhash64(*PAIR)), words).repartition("bucket")
    tables = {KEYS: keys, FILTER: store.stage(FILTER, bits, version, ("bucket",))}
    return store.commit(state, tables, {"index": {**index, "words": words, "dropped": []}})
