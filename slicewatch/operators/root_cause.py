"""Explain each event by its peers in the same window.

All events are diagnosed in one job, without pairing an event with every row of its peers:

* the targets of an event are its own slice, the slices that share its method or its gateway, and the
  series of totals over all slices (one row per cell time);
* a target's sums over the event window are differences of its running totals: each (event, target)
  adds two points, window start and end, to the target's series, and one running pass per (series,
  time chunk) hands every point the totals of the rows before it. Totals of earlier chunks come from a
  table of one row per (series, chunk), so neither a long series nor a long window is one task;
* the rate of "every other slice" is the series of totals minus the event's own slice.
Per (event, peer) means are then folded into per-event verdicts with conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.functions.exprs import classification_expr, statement_expr
from slicewatch.functions.numeric import RATE_DEC, round_double, safe_div
from slicewatch.functions.timeutil import bucket_of, buckets_covering, epoch_seconds
from slicewatch.operators.baseline import SLICE
from slicewatch.params import Params

def in_window() -> Column:
    return (F.col("ts") >= F.col("window_start")) & (F.col("ts") < F.col("window_end"))


def event_buckets(events: DataFrame, bucket_seconds: int) -> DataFrame:
    return events.select(
        "event_id",
        F.col("payment_method").alias("e_method"),
        F.col("bank_gateway").alias("e_gateway"),
        "window_start",
        "window_end",
        F.explode(buckets_covering("window_start", "window_end", bucket_seconds)).alias("bucket"),
    )


def _health_b(health: DataFrame, p: Params) -> DataFrame:
    return health.select(*SLICE, "ts", "success_rate", "avg_latency_ms", "transaction_volume",
                         bucket_of("ts", p.bucket_seconds).alias("h_bucket"))


def own_rows(events: DataFrame, health: DataFrame, p: Params = Params()) -> DataFrame:
    """Health rows of each event's own slice inside its window (join on slice + bucket)."""
    eb = event_buckets(events, p.bucket_seconds)
    h = _health_b(health, p)
    cond = [eb.bucket == h.h_bucket, eb.e_method == h.payment_method, eb.e_gateway == h.bank_gateway]
    return eb.join(h, cond).where(in_window()).select("event_id", "ts", "success_rate", "avg_latency_ms",
                                                    "transaction_volume")


def window_summary(events: DataFrame, health: DataFrame, p: Params = Params()) -> DataFrame:
    """D1 for many windows at once: the event's own slice over its window (unweighted means)."""
    agg = own_rows(events, health, p).groupBy("event_id").agg(
        F.sum(F.col("success_rate").cast(RATE_DEC)).alias("s_rate"),
        F.count("success_rate").alias("n_rate"),
        F.sum(F.col("avg_latency_ms").cast("decimal(30,6)")).alias("s_lat"),
        F.count("avg_latency_ms").alias("n_lat"),
        F.sum("transaction_volume").alias("vol"),
    )
    return events.select("event_id").join(agg, "event_id", "left").select(
        "event_id",
        safe_div(F.col("s_rate"), F.col("n_rate")).alias("success_rate"),
        safe_div(F.col("s_lat"), F.col("n_lat")).alias("avg_latency_ms"),
        F.coalesce(F.col("vol"), F.lit(0)).cast("bigint").alias("transaction_volume"),
    )


_TOTALS = {"n_rows": "bigint", "n_rate": "bigint", "s_rate": "decimal(30,10)"}
DEFAULT_CHUNK_HOURS = 240


def _series(health: DataFrame) -> DataFrame:
    """Addable rows of every slice, and of all slices together (``_all``; one row per cell time)."""
    rate = F.when(~F.isnan("success_rate"), F.col("success_rate")).cast(RATE_DEC)
    rows = health.select(*SLICE, "ts", rate.alias("rate"))
    own = rows.where(F.col("payment_method").isNotNull() & F.col("bank_gateway").isNotNull()).select(
        F.lit(False).alias("_all"), *SLICE, "ts", F.lit(1).cast("bigint").alias("n_rows"),
        F.col("rate").isNotNull().cast("bigint").alias("n_rate"), F.coalesce("rate", F.lit(0)).cast(_TOTALS["s_rate"]).alias("s_rate"))
    every = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("n_rows"), F.count("rate").alias("n_rate"), F.sum("rate").alias("s_rate"))
    return own.unionByName(every.select(
        F.lit(True).alias("_all"), F.lit("").alias("payment_method"), F.lit("").alias("bank_gateway"), "ts", "n_rows", "n_rate",
        F.coalesce("s_rate", F.lit(0)).cast(_TOTALS["s_rate"]).alias("s_rate")))


def _targets(events: DataFrame, health: DataFrame) -> DataFrame:
    """(event, target series): the slices of the event's method or gateway, and the series of totals."""
    slices = health.select(*SLICE).distinct()
    ev = events.select("event_id", F.col("payment_method").alias("e_method"), F.col("bank_gateway").alias("e_gateway"),
                       "window_start", "window_end")
    same_method = ev.join(slices, ev.e_method == slices.payment_method)
    same_gateway = ev.join(slices, ev.e_gateway == slices.bank_gateway).where(F.col("payment_method") != F.col("e_method"))
    every = ev.select("*", F.lit("").alias("payment_method"), F.lit("").alias("bank_gateway"))
    return same_method.unionByName(same_gateway).withColumn("_all", F.lit(False)).unionByName(every.withColumn("_all", F.lit(True)))


def window_totals(events: DataFrame, health: DataFrame, p: Params = Params(), cut: bool = False) -> DataFrame:
    """Rows, known rates and their sum of each (event, target) inside the event window. ``cut=True``
    writes the lines of rows and points once, as the running totals and the offsets both read them."""
    series_key = ("_all", *SLICE)
    chunk = F.floor(epoch_seconds("ts") / F.lit(int(p.time_chunk_hours or DEFAULT_CHUNK_HOURS) * 3600)).cast("bigint")
    ends = F.array(F.struct(F.col("window_start").alias("ts"), F.lit(-1).alias("sign")),
                   F.struct(F.col("window_end").alias("ts"), F.lit(1).alias("sign")))
    points = _targets(events, health).withColumn("_end", F.explode(ends)).select(
        *series_key, F.col("_end.ts").alias("ts"), F.col("_end.sign").alias("sign"), "event_id", "e_method", "e_gateway")
    zeros = {c: F.lit(0).cast(t) for c, t in _TOTALS.items()}
    line = points.withColumns(zeros).unionByName(_series(health), allowMissingColumns=True).withColumn("_chunk", chunk)
    if cut:
        from slicewatch.session import cut_lineage
        line = cut_lineage(line, "lines")
    before = Window.partitionBy("_chunk", *series_key).orderBy(
        "ts", F.col("sign").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)   # a point comes before the row of its time
    passed = line.select("*", *[F.sum(c).over(before).cast(t).alias("_" + c) for c, t in _TOTALS.items()]).where(F.col("sign").isNotNull())
    earlier = Window.partitionBy(*series_key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (line.groupBy("_chunk", *series_key).agg(*[F.sum(c).cast(t).alias(c) for c, t in _TOTALS.items()])
               .select("_chunk", *series_key, *[F.coalesce(F.sum(c).over(earlier).cast(t), F.lit(0).cast(t)).alias("_o" + c)
                                                for c, t in _TOTALS.items()]))
    return (passed.join(offsets, ["_chunk", *series_key]).groupBy("event_id", "e_method", "e_gateway", *series_key)
            .agg(*[F.sum(F.col("sign") * (F.col("_" + c) + F.col("_o" + c))).cast(t).alias(c) for c, t in _TOTALS.items()]))


def _rated(totals: DataFrame) -> DataFrame:
    mean = safe_div(F.col("s_rate"), F.col("n_rate"))
    peer = ~F.col("_all") & (F.col("n_rows") > 0)
    same_method, same_gateway = F.col("payment_method") == F.col("e_method"), F.col("bank_gateway") == F.col("e_gateway")
    return totals.select("event_id", "e_method", "e_gateway", "_all", *SLICE, "n_rows", "n_rate", "s_rate",
                         mean.alias("mean_rate"), round_double(mean, 4).alias("rate"),
                         (peer & same_method & ~same_gateway).alias("is_peer_gateway"),
                         (peer & same_gateway & ~same_method).alias("is_peer_method"),
                         (~F.col("_all") & same_method & same_gateway).alias("is_own"))


def peer_rates(events: DataFrame, health: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per (event, peer slice seen in the window): peer gateways of the same method and
    peer methods of the same gateway, with row counts and the mean rate rounded to 4 (D2)."""
    return (_rated(window_totals(events, health, p)).where(F.col("is_peer_gateway") | F.col("is_peer_method"))
            .drop("_all", "is_own"))


def root_cause(events: DataFrame, health: DataFrame, p: Params = Params(), cut: bool = False) -> DataFrame:
    """Per event: peer stability, global rate, classification, best peer, statement, rate maps."""
    pr = _rated(window_totals(events, health, p, cut))
    thr = F.lit(p.healthy_threshold)
    healthy = F.coalesce(F.col("rate") >= thr, F.lit(False))     # a null mean counts as unhealthy
    pg, pm = F.col("is_peer_gateway"), F.col("is_peer_method")
    best_key = F.struct(-F.col("rate"), F.col("bank_gateway"))     # rate desc, then name asc
    per_event = pr.groupBy("event_id").agg(
        F.bool_and(F.when(pg, healthy)).alias("gw_ok"),
        F.bool_and(F.when(pm, healthy)).alias("m_ok"),
        F.count(F.when(pg, 1)).alias("n_peer_gateways"),
        F.count(F.when(pm, 1)).alias("n_peer_methods"),
        F.min_by(F.when(pg & F.col("rate").isNotNull(), F.col("bank_gateway")),
                 F.when(pg & F.col("rate").isNotNull(), best_key)).alias("best_peer"),
        F.max(F.when(pg, F.col("rate"))).alias("best_peer_rate"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(pg, F.struct("bank_gateway", "rate"))))).alias("other_gateway_rates"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(pm, F.struct("payment_method", "rate"))))).alias("other_method_rates"),
        # C10 + D4: every other slice = all slices minus the event's own
        *[F.sum(F.when(F.col("_all"), F.col(c)).when(F.col("is_own"), -F.col(c))).alias(f"other_{c}") for c in _TOTALS],
    )
    ev = events.join(per_event, "event_id", "left")
    gw_stable = F.coalesce(F.col("gw_ok"), F.lit(True))
    m_stable = F.coalesce(F.col("m_ok"), F.lit(True))
    global_rate = safe_div(F.col("other_s_rate"), F.col("other_n_rate"))
    no_global = F.coalesce(F.col("other_n_rows"), F.lit(0)) == 0
    isolated = gw_stable & m_stable & (no_global | F.coalesce(global_rate >= thr, F.lit(False)))
    out = ev.select(
        *[F.col(c) for c in events.columns],
        gw_stable.alias("other_gateways_stable"),
        m_stable.alias("other_methods_stable"),
        global_rate.alias("global_other_rate"),
        isolated.alias("is_isolated"),
        F.coalesce("n_peer_gateways", F.lit(0)).alias("n_peer_gateways"),
        F.coalesce("n_peer_methods", F.lit(0)).alias("n_peer_methods"),
        "best_peer",
        "best_peer_rate",
        "other_gateway_rates",
        "other_method_rates",
    ).withColumn("classification", classification_expr("is_isolated", "other_gateways_stable", "other_methods_stable"))
    return out.withColumn(
        "root_cause_statement",
        statement_expr("classification", "payment_method", "bank_gateway", "baseline_rate", "current_rate",
                       "window_start", "window_end", "best_peer", "best_peer_rate", "global_other_rate"),
    ).withColumn("global_other_slices_avg_rate", round_double("global_other_rate", 4))
