"""Merge adjacent breaching rows of a slice into degradation events.

Gaps-and-islands: a running count of non-breaching rows (explicit ROWS frame) is constant across
a run of breaching rows, so (slice, island) identifies a run. The baseline windows, the island
window and the run aggregate all cluster on the slice key, so Spark plans a single exchange.
Adjacency is by row, not by clock (a missing cell does not break a run); ``Params.strict_gaps``
switches to adjacency by clock.

Event ids are dense 1-based numbers in (method, gateway, window_start) order, built without a
global single-partition window: rank inside each slice, plus the running total of events of the
slices before it (a table with one row per slice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.functions.exprs import severity_expr
from slicewatch.functions.numeric import VALUE_DEC, round_double
from slicewatch.functions.timeutil import add_hours, epoch_seconds
from slicewatch.operators.baseline import SLICE, chunk_of, chunk_offsets, slice_window, with_baseline, with_breach
from slicewatch.params import Params

EVENT_COLUMNS = (
    "event_id", "payment_method", "bank_gateway", "window_start", "window_end",
    "baseline_rate", "current_rate", "severity", "z_score", "n_rows",
)


def with_island(flagged: DataFrame, p: Params = Params()) -> DataFrame:
    """Island id = running count of rows that cannot continue a run. By default that is every
    non-breaching row (adjacency by row); with ``strict_gaps`` a breaching row more than one grain
    after the previous row of its slice also starts a new run (adjacency by clock)."""
    chunked = bool(p.time_chunk_hours) and "_rn" in flagged.columns
    breaks = ~F.col("breach")
    if p.strict_gaps:
        prev_ts = F.col("_prev_ts") if chunked else F.lag("ts", 1).over(slice_window())
        gap = epoch_seconds("ts") - epoch_seconds(prev_ts)
        breaks = breaks | F.coalesce(gap > F.lit(int(p.grain_hours) * 3600), F.lit(False))
    b = F.when(breaks, 1).otherwise(0).cast("bigint")
    if not chunked:
        run = slice_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return flagged.withColumn("island", F.sum(b).over(run))
    # chunked plan: running count inside each (slice, chunk) plus the counts of earlier chunks
    x = flagged.withColumn("_chunk", chunk_of(p)).withColumn("_b", b)
    wc = Window.partitionBy(*SLICE, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loc = x.withColumn("_lb", F.sum("_b").over(wc))
    off = chunk_offsets(loc.groupBy(*SLICE, "_chunk").agg(F.sum("_b").alias("b")), {"b": "bigint"})
    return (loc.join(off, [*SLICE, "_chunk"]).withColumn("island", F.col("_ob") + F.col("_lb"))
            .drop("_chunk", "_b", "_lb", "_ob"))


def runs(flagged: DataFrame, p: Params = Params()) -> DataFrame:
    """Breaching runs of at least ``min_run_rows`` rows, with their unrounded means."""
    isl = with_island(flagged, p).where(F.col("breach"))
    g = isl.groupBy(*SLICE, "island").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("ts").alias("window_start"),
        F.max("ts").alias("last_ts"),
        F.sum(F.col("rolling_baseline_success_rate").cast(VALUE_DEC)).cast("double").alias("s_base"),
        F.sum(F.col("success_rate").cast(VALUE_DEC)).cast("double").alias("s_rate"),
        F.sum(F.col("z_score").cast(VALUE_DEC)).cast("double").alias("s_z"),
    )
    return run_means(g, p)


def run_means(g: DataFrame, p: Params = Params()) -> DataFrame:
    """Runs of at least ``min_run_rows`` rows, with their means and the end of their window."""
    return (
        g.where(F.col("n_rows") >= F.lit(int(p.min_run_rows)))
        .withColumn("mean_base", F.col("s_base") / F.col("n_rows"))
        .withColumn("mean_rate", F.col("s_rate") / F.col("n_rows"))
        .withColumn("mean_z", F.col("s_z") / F.col("n_rows"))
        .withColumn("window_end", add_hours("last_ts", p.grain_hours))
    )


def event_rows(r: DataFrame, p: Params = Params()) -> DataFrame:
    """Event columns (without number) of the runs ``runs`` gives."""
    return r.select(
        *SLICE,
        "window_start",
        "window_end",
        round_double("mean_base", 4).alias("baseline_rate"),
        round_double("mean_rate", 4).alias("current_rate"),
        severity_expr(F.col("mean_base") - F.col("mean_rate"), p).alias("severity"),
        round_double("mean_z", 2).alias("z_score"),
        "n_rows",
    )


def number_events(ev: DataFrame, order_col: str = "window_start") -> DataFrame:
    """Dense global ids in (slice, order_col) order without a single-partition window."""
    ev = ev.withColumn("_rank", F.row_number().over(Window.partitionBy(*SLICE).orderBy(order_col)))
    per_slice = ev.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("_n"))
    # one row per slice: the running offset is cheap however many events there are
    offsets = per_slice.withColumn(
        "_offset",
        F.coalesce(
            F.sum("_n").over(Window.orderBy(*SLICE).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("_n")
    return (ev.join(offsets, list(SLICE))
            .withColumn("event_id", (F.col("_offset") + F.col("_rank")).cast("bigint"))
            .drop("_offset", "_rank"))


def detect_events(health: DataFrame, p: Params = Params(), cut: bool = False) -> DataFrame:
    """health series → degradation events (one row per event).

    ``cut=True`` checkpoints the (small) run table before numbering, so the numbering's second
    pass reads the checkpoint instead of recomputing the detection, and checkpoints the numbered
    events, which root cause and linkage read several times.
    """
    flagged = with_breach(with_baseline(health, p, keep_order=True), p)
    if cut and p.time_chunk_hours:
        # the chunked island step reads the flags twice (rows and per-chunk break counts)
        from slicewatch.session import cut_lineage
        flagged = cut_lineage(flagged, "flagged")
    ev = event_rows(runs(flagged, p), p)
    if not cut:
        return number_events(ev).select(*EVENT_COLUMNS)
    from slicewatch.session import cut_lineage
    return cut_lineage(number_events(cut_lineage(ev, "runs")).select(*EVENT_COLUMNS), "numbered")


def severity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("severity").agg(F.count(F.lit(1)).alias("n_events"))
