"""Slice × time-cell rollup of raw payment attempts into a health series, over mergeable sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.functions.numeric import safe_div

CELL = ["payment_method", "bank_gateway", "ts"]
SUMS = ["transaction_volume", "n_ok", "n_known", "lat_sum", "n_lat"]
SUM_DEC = "decimal(38,6)"


def cell_sums(attempts: DataFrame, grain_hours: int) -> DataFrame:
    """One row per (slice, cell) with the sums that its rates are made of. Sums of parts of the attempts add up
    to the sums of all (``merge_sums``).

    Tumbling ``window`` is a projection, so the aggregate is partial per task (map-side combine)
    and only one row per (slice, cell, task) is shuffled — a hot slice does not hot-spot a reducer.
    """
    cell = F.window("ts", f"{int(grain_hours)} hours")
    agg = attempts.groupBy("payment_method", "bank_gateway", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("transaction_volume"),
        F.sum(F.col("ok").cast("int")).alias("n_ok"),
        F.count("ok").alias("n_known"),
        F.sum(F.col("latency_ms").cast("decimal(30,6)")).cast(SUM_DEC).alias("lat_sum"),
        F.count("latency_ms").alias("n_lat"),
    )
    return agg.select("payment_method", "bank_gateway", F.col("cell.start").alias("ts"), *SUMS)


def merge_sums(sums: DataFrame) -> DataFrame:
    """Sums of several parts, one row per cell again."""
    return sums.groupBy(*CELL).agg(*[F.sum(c).cast(SUM_DEC).alias(c) if c == "lat_sum" else F.sum(c).alias(c) for c in SUMS])


def health_of(sums: DataFrame) -> DataFrame:
    """The health series of merged sums: success_rate, avg_latency_ms (unweighted), transaction_volume."""
    return sums.select(
        "ts", "payment_method", "bank_gateway",
        safe_div(F.col("n_ok"), F.col("n_known")).alias("success_rate"),
        safe_div(F.col("lat_sum"), F.col("n_lat")).alias("avg_latency_ms"),
        "transaction_volume",
    )


def health_rollup(attempts: DataFrame, grain_hours: int) -> DataFrame:
    """One row per (slice, cell) of all attempts at hand."""
    return health_of(cell_sums(attempts, grain_hours))
