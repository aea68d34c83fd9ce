"""Trailing baseline per slice and the breach predicate.

The baseline covers the ``baseline_rows`` rows before the current one (current row excluded),
null until ``baseline_min_periods`` non-null values exist. Mean and sample standard deviation
come from exact DECIMAL sums, so the numbers do not depend on how the frame is evaluated. One
exchange on the slice key serves every window of the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.functions.numeric import RATE_DEC, VALUE_DEC
from slicewatch.functions.timeutil import epoch_seconds
from slicewatch.params import Params

SLICE = ("payment_method", "bank_gateway")


def slice_window() -> Window:
    return Window.partitionBy(*SLICE).orderBy("ts")


HEALTH_COLS = ("ts", "success_rate", "avg_latency_ms", "transaction_volume")
# Running-total types: exact, with headroom so that adding an offset or taking a difference of two
# totals never needs more than 38 digits (Spark would otherwise drop a digit of scale).
CUM_TYPES = {"n": "bigint", "s": "decimal(30,10)", "ss": "decimal(32,20)", "nl": "bigint", "sl": "decimal(37,12)"}


def _cum_aggs() -> dict[str, Column]:
    rate = F.col("success_rate").cast(RATE_DEC)
    return {"n": F.count("success_rate"), "s": F.sum(rate), "ss": F.sum(rate * rate),
            "nl": F.count("avg_latency_ms"), "sl": F.sum(F.col("avg_latency_ms").cast(VALUE_DEC))}


def chunk_of(p: Params) -> Column:
    return F.floor(epoch_seconds("ts") / F.lit(int(p.time_chunk_hours) * 3600)).cast("bigint")


def chunk_offsets(per_chunk: DataFrame, types: dict[str, str]) -> DataFrame:
    """Exclusive prefix over the chunks of each slice: totals of all earlier chunks. The input has
    one row per (slice, chunk), so this window is small however long or hot a slice is."""
    w = Window.partitionBy(*SLICE).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(*SLICE, "_chunk", *[
        F.coalesce(F.sum(c).over(w).cast(t), F.lit(0).cast(t)).alias("_o" + c) for c, t in types.items()])


def _lag_sums(health: DataFrame, p: Params) -> DataFrame:
    """Trailing sums as differences of running totals per slice (one pass over the sorted slice)."""
    run = slice_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = slice_window()
    k = int(p.baseline_rows)
    aggs = _cum_aggs()
    totals = health.select(*SLICE, *HEALTH_COLS,
                           *[a.over(run).cast(CUM_TYPES[c]).alias("_c" + c) for c, a in aggs.items()])

    def trailing(c: str) -> Column:
        zero = F.lit(0)
        return F.coalesce(F.lag(c, 1).over(w), zero) - F.coalesce(F.lag(c, k + 1).over(w), zero)

    return totals.select(*SLICE, *HEALTH_COLS, *[trailing("_c" + c).alias("_" + c) for c in aggs])


def _chunked_sums(health: DataFrame, p: Params) -> DataFrame:
    """Trailing sums without a slice-wide window (``time_chunk_hours``): a slice's rows spread over
    (slice, time chunk) tasks, so one long or hot slice is not one task.

    1. Running totals and row numbers inside each (slice, chunk), plus per-chunk offsets (the totals
       of all earlier chunks) give every row its global row number and running totals.
    2. Each row is emitted three times, keyed by its own, its next and its next-plus-``baseline_rows``
       global row number; one group-by on (slice, row number) then hands every row the running
       totals of rows i-1 and i-1-k. The frame may span any number of chunks; the result is exact.
    Also returns ``_rn`` (global row number) and ``_prev_ts`` for the island step.
    """
    k = int(p.baseline_rows)
    aggs = _cum_aggs()
    wc = Window.partitionBy(*SLICE, "_chunk").orderBy("ts")
    runc = wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = health.select(*SLICE, *HEALTH_COLS).withColumn("_chunk", chunk_of(p))
    loc = base.select("*", F.row_number().over(wc).cast("bigint").alias("_lrn"),
                      *[a.over(runc).cast(CUM_TYPES[c]).alias("_l" + c) for c, a in aggs.items()])
    types = {"rn": "bigint", **CUM_TYPES}
    per = loc.groupBy(*SLICE, "_chunk").agg(F.count(F.lit(1)).alias("rn"),
                                            *[a.cast(CUM_TYPES[c]).alias(c) for c, a in aggs.items()])
    g = loc.join(chunk_offsets(per, types), [*SLICE, "_chunk"]).select(
        *SLICE, *HEALTH_COLS, (F.col("_orn") + F.col("_lrn")).alias("_rn"),
        *[(F.col("_o" + c) + F.col("_l" + c)).cast(CUM_TYPES[c]).alias("_c" + c) for c in aggs])
    copies = F.array(*[F.struct(F.lit(r).alias("role"), (F.col("_rn") + off).alias("key"))
                       for r, off in ((0, 0), (1, 1), (2, k + 1))])
    x = g.select("*", F.explode(copies).alias("_copy"))
    role = F.col("_copy.role")

    def pick(r: int, c: str) -> Column:
        return F.max(F.when(role == r, F.col(c)))

    t = x.groupBy(*SLICE, F.col("_copy.key").alias("_rn")).agg(
        F.count(F.when(role == 0, 1)).alias("_self"),
        *[pick(0, h).alias(h) for h in HEALTH_COLS],
        pick(1, "ts").alias("_prev_ts"),
        *[pick(1, "_c" + c).alias("_p" + c) for c in aggs],
        *[pick(2, "_c" + c).alias("_k" + c) for c in aggs],
    ).where(F.col("_self") == 1)
    zero = F.lit(0)
    return t.select(*SLICE, *HEALTH_COLS, "_rn", "_prev_ts", *[
        (F.coalesce(F.col("_p" + c), zero) - F.coalesce(F.col("_k" + c), zero)).alias("_" + c) for c in aggs])


def with_baseline(health: DataFrame, p: Params = Params(), keep_order: bool = False) -> DataFrame:
    """Trailing count / sum / sum of squares over the ``baseline_rows`` rows before each row.

    A moving ROWS frame is re-aggregated row by row (O(rows × frame)); instead each trailing sum is
    the difference of two running totals, ``total[i-1] - total[i-1-baseline_rows]``. The totals are
    DECIMALs or counts, so the difference is exactly the frame sum. Default plan: running frames and
    ``lag`` over each slice (one exchange on the slice). With ``p.time_chunk_hours`` the same sums
    come from the chunked plan (``_chunked_sums``); ``keep_order`` then keeps ``_rn``/``_prev_ts``.
    """
    # a NaN measure is a missing one
    health = health.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("success_rate", "avg_latency_ms")})
    if p.time_chunk_hours:
        sums = _chunked_sums(health, p)
        extra = ("_rn", "_prev_ts") if keep_order else ()
    else:
        sums, extra = _lag_sums(health, p), ()
    n = F.col("_n")
    s = F.col("_s").cast("double")
    ss = F.col("_ss").cast("double")
    n_lat = F.col("_nl")
    s_lat = F.col("_sl").cast("double")
    enough = n >= F.lit(int(p.baseline_min_periods))
    var = (ss - s * s / n) / (n - F.lit(1))
    return sums.select(
        *SLICE,
        *HEALTH_COLS,
        *extra,
        F.when(enough, s / n).alias("rolling_baseline_success_rate"),
        F.when(enough, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("rolling_baseline_std"),
        F.when(n_lat >= F.lit(int(p.baseline_min_periods)), s_lat / n_lat).alias("rolling_baseline_latency"),
    )


def drop_expr() -> Column:
    return F.col("rolling_baseline_success_rate") - F.col("success_rate")


def z_expr(p: Params = Params()) -> Column:
    std = F.greatest(F.coalesce(F.col("rolling_baseline_std"), F.lit(p.std_fill)), F.lit(p.std_floor))
    return drop_expr() / std


def breach_expr(p: Params = Params()) -> Column:
    has_base = F.col("rolling_baseline_success_rate").isNotNull()
    cond = has_base & ((drop_expr() >= F.lit(p.min_drop)) | (z_expr(p) >= F.lit(p.z_threshold)))
    # SQL three-valued logic: a null comparison is "not a breach"
    return F.coalesce(cond, F.lit(False))


def with_breach(enriched: DataFrame, p: Params = Params()) -> DataFrame:
    return enriched.withColumns({
        "drop_pct_points": drop_expr(),
        "z_score": z_expr(p),
        "breach": breach_expr(p),
    })


def baseline_coverage(enriched: DataFrame) -> DataFrame:
    """B14 + D16: per slice, rows with a baseline, first/last ts and the lowest rate."""
    return enriched.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("rolling_baseline_success_rate").alias("n_with_baseline"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("success_rate").alias("min_success_rate"),
    )
