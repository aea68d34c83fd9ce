"""Link failed transactions to degradation events.

Interval join on slice equality and ``window_start <= ts < window_end``; when windows overlap
the lowest event id wins; unmatched transactions keep a null event id.

Plan: overlaps are settled on the event side. The windows of a slice are cut at all their ends into stretches, and
each stretch learns the lowest event id that covers it by a minimum over hierarchical pieces (n log n rows for n
windows, no list per key). The stretches no longer overlap, so a transaction meets one at most. They are cut into
hierarchical pieces once more, over time buckets: blocks of 1, 16, 256, ... whole buckets, and the ends that fill
no bucket as they are. A window of a year is some dozens of pieces instead of one per bucket. A transaction probes
one piece per level in use (two or three for windows of hours) by equality, with no fan-out and no
de-duplication on the huge transaction side; the context of the matched event (statement, peers) is attached by event id
afterwards. The piece and context tables are broadcast only when measured below ``broadcast_max_rows`` rows and
``broadcast_max_bytes`` bytes; otherwise both sides shuffle on (slice, block), or on the event id with
the unmatched rows spread over keys of their own, and AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.functions.intervals import block_of, with_pieces
from slicewatch.functions.timeutil import epoch_micros
from slicewatch.operators.baseline import SLICE
from slicewatch.params import Params
from slicewatch.session import cut_lineage


UNMATCHED_KEYS = 4096     # keys that rows without an event spread over
EDGE = -1                 # level of the pieces that fill no whole bucket


def stretches(events: DataFrame) -> DataFrame:
    """(slice, event_id, lo, hi) in microseconds: windows cut so that none overlap, each part with the lowest id that
    covers it. Windows that are empty or miss an end go."""
    whole = events.select(*SLICE, "event_id", epoch_micros("window_start").alias("lo"), epoch_micros("window_end").alias("hi")).where("lo < hi")
    before = Window.partitionBy(*SLICE).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    overlaps = whole.withColumn("_before", F.max("hi").over(before)).where(F.col("lo") < F.col("_before"))
    if not overlaps.limit(1).count():
        return whole
    cuts = whole.select(*SLICE, F.col("lo").alias("at")).unionByName(whole.select(*SLICE, F.col("hi").alias("at"))).distinct()
    order = Window.partitionBy(*SLICE).orderBy("at")
    cuts = cut_lineage(cuts.select(*SLICE, "at", (F.row_number().over(order) - 1).cast("bigint").alias("nr"),
                                   F.lead("at").over(order).alias("next")), "cuts")
    first, end = (cuts.select(*SLICE, F.col("at").alias(c), F.col("nr").alias(n)) for c, n in (("lo", "n_lo"), ("hi", "n_hi")))
    numbered = whole.join(first, [*SLICE, "lo"]).join(end, [*SLICE, "hi"]).select(*SLICE, "event_id", "n_lo", "n_hi")
    lowest = cut_lineage(with_pieces(numbered, "n_lo", "n_hi", bits=1, levels=40)
                         .groupBy(*SLICE, "level", "block").agg(F.min("event_id").alias("event_id")), "lowest")
    levels = sorted(r[0] for r in lowest.select("level").distinct().collect())       # at most 40
    steps = cuts.where("next is not null").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    steps = steps.withColumn("block", block_of(F.col("nr"), F.col("level"), bits=1))
    return steps.join(lowest, [*SLICE, "level", "block"]).groupBy(*SLICE, F.col("at").alias("lo"), F.col("next").alias("hi")).agg(
        F.min("event_id").alias("event_id")).select(*SLICE, "event_id", "lo", "hi")


def event_pieces(events: DataFrame, bucket_seconds: int) -> DataFrame:
    """(slice, level, block, lo, hi, event_id): pieces that do not overlap. From level 0 a block counts whole; an ``EDGE``
    piece covers its bucket from lo to hi only."""
    unit = F.lit(int(bucket_seconds) * 1_000_000)
    up = lambda x: F.call_function("div", x + F.pmod(-x, unit), unit)
    down = lambda x: F.call_function("div", x - F.pmod(x, unit), unit)
    s = stretches(events).withColumns({"_lo": up(F.col("lo")), "_hi": down(F.col("hi"))})
    columns = [*SLICE, "level", "block", "lo", "hi", "event_id"]
    whole = with_pieces(s, "_lo", "_hi").select(*columns)
    ends = F.array_compact(F.array_distinct(F.array(
        F.when(F.pmod(F.col("lo"), unit) != 0, down(F.col("lo"))), F.when(F.pmod(F.col("hi"), unit) != 0, down(F.col("hi"))))))
    edge = s.withColumn("block", F.explode(ends)).withColumn("level", F.lit(EDGE)).select(*columns)
    return whole.unionByName(edge)


def small_enough(small: DataFrame, max_rows: int, max_bytes: int, also=()) -> tuple:
    """(whether ``small`` has at most ``max_rows`` rows and about ``max_bytes`` bytes, the values of ``also``). One
    aggregate, partial per task, measures it (JSON-encoded length, a close upper estimate of the row
    size); only the one-row summary reaches the driver."""
    st = small.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct(*small.columns)))), F.lit(0)).alias("bytes"), *also,
    ).first()
    return st["n"] <= max_rows and st["bytes"] <= max_bytes, *st[2:]


def maybe_broadcast(small: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``small`` only if it is ``small_enough``."""
    return F.broadcast(small) if small_enough(small, max_rows, max_bytes)[0] else small


def link(txns: DataFrame, events: DataFrame, p: Params = Params(), carry: tuple[str, ...] = (),
         broadcast_check: bool = True) -> DataFrame:
    """Every transaction, plus ``event_id`` (null when unmatched), ``degradation_linked`` and the
    ``carry`` columns of the matched event (e.g. the root-cause statement, C12). A ``degradation_linked`` that
    comes in is the seed label (D14) and is kept as ``seed_linked``."""
    if "degradation_linked" in txns.columns and "seed_linked" not in txns.columns:
        txns = txns.withColumnRenamed("degradation_linked", "seed_linked")
    keep = [c for c in txns.columns if c not in ("event_id", "degradation_linked", *carry)]
    pieces = cut_lineage(event_pieces(events, p.bucket_seconds), "pieces")
    fits, levels = small_enough(pieces, p.broadcast_max_rows, p.broadcast_max_bytes, (F.sort_array(F.collect_set("level")),))
    out = txns.select(*keep).withColumn("_at", epoch_micros("ts"))
    unit = F.lit(int(p.bucket_seconds) * 1_000_000)
    out = out.withColumn("_bucket", F.call_function("div", F.col("_at") - F.pmod(F.col("_at"), unit), unit))
    found = []
    for level in levels:                         # a handful: each is 16 times longer than the one before
        mine = pieces.where(F.col("level") == level).select(
            *[F.col(c).alias(f"_p_{c}") for c in (*SLICE, "block", "lo", "hi")], F.col("event_id").alias(f"_event_{level + 1}"))
        mine = F.broadcast(mine) if fits and broadcast_check else mine
        on = [F.col(c) == F.col(f"_p_{c}") for c in SLICE]
        on.append(block_of(F.col("_bucket"), max(level, 0)) == F.col("_p_block"))
        if level == EDGE:
            on += [F.col("_at") >= F.col("_p_lo"), F.col("_at") < F.col("_p_hi")]
        out = out.join(mine, on, "left").drop(*[f"_p_{c}" for c in (*SLICE, "block", "lo", "hi")])
        found.append(F.col(f"_event_{level + 1}"))
    event_id = F.coalesce(*found) if found else F.lit(None).cast(events.schema["event_id"].dataType)
    out = out.select(*keep, event_id.alias("event_id"), event_id.isNotNull().alias("degradation_linked"))
    if not carry:
        return out
    context = events.select(F.col("event_id").alias("_event"), *carry)
    if broadcast_check:
        context = maybe_broadcast(context, p.broadcast_max_rows, p.broadcast_max_bytes)
    apart = -1 - F.pmod(F.xxhash64("transaction_id"), F.lit(UNMATCHED_KEYS))      # event ids are positive
    return out.withColumn("_event", F.coalesce("event_id", apart)).join(context, "_event", "left").drop("_event")


def link_single(txns: DataFrame, event: DataFrame, p: Params = Params()) -> DataFrame:
    """Linkage against one event (a one-row events frame)."""
    return link(txns, event, p)


def with_after_recovery_probability(linked: DataFrame, floor: float = 0.82) -> DataFrame:
    """q = max(p, floor) for linked transactions, p otherwise (test-data formula)."""
    p_now = F.col("ground_truth_recovery_probability")
    return linked.withColumn(
        "ground_truth_recovery_probability_after_recovery",
        F.when(F.col("degradation_linked"), F.greatest(p_now, F.lit(floor))).otherwise(p_now),
    )


def linkage_summary(linked: DataFrame, events: DataFrame) -> DataFrame:
    """D13 + D14: events, linked and total transactions, agreement with the seed label (null without one)."""
    agree = F.count_if(F.col("degradation_linked") == F.col("seed_linked")) if "seed_linked" in linked.columns else F.lit(None).cast("bigint")
    t = linked.agg(
        F.count(F.lit(1)).alias("transactions_total"),
        F.count_if(F.col("degradation_linked")).alias("transactions_linked"),
        agree.alias("label_agreement"),
    )
    e = events.agg(F.count(F.lit(1)).alias("events_detected"))
    # both sides are single-row global aggregates; join them on a constant key
    return e.withColumn("_k", F.lit(1)).join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")


def gt_probability_by_link(linked: DataFrame) -> DataFrame:
    """Mean ground-truth probability per linkage flag."""
    from slicewatch.functions.numeric import exact_mean
    return linked.groupBy("degradation_linked").agg(
        F.count(F.lit(1)).alias("n"),
        exact_mean("ground_truth_recovery_probability").alias("mean_p_now"),
        exact_mean("ground_truth_recovery_probability_after_recovery").alias("mean_p_after"),
    )
