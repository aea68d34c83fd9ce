"""Second attempts source: order lines of ``lineitem ⋈ orders ⋈ customer`` as payment attempts.

    payment_method  = o_orderpriority
    bank_gateway    = c_mktsegment
    ts              = o_orderdate
    ok              = l_returnflag <> 'R'      (a returned line is a failed attempt)
    latency_ms      = l_extendedprice

The health cells only need per-cell counts and sums, so lines are first collapsed per order
(partial aggregation on the scan side, one row per order shuffled instead of every line). The
per-order table is then hash-partitioned on the order key, which the orders join reuses; customer
is broadcast only behind a bounded row count, otherwise it is a shuffle join on the customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.functions.numeric import safe_div
from slicewatch.operators.linkage import maybe_broadcast
from slicewatch.params import Params
from slicewatch.sources.payments import read_table

# Cell grain of the order-line source, the same at every size.
ORDER_LINE_GRAIN_HOURS = 24


def per_order(lineitem: DataFrame) -> DataFrame:
    ok = F.col("l_returnflag") != F.lit("R")
    return lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ok.cast("int")).alias("n_ok"),
        F.count(ok).alias("n_known"),
        F.sum(F.col("l_extendedprice").cast("decimal(30,6)")).alias("lat_sum"),
        F.count("l_extendedprice").alias("n_lat"),
    )


def order_line_health(orders: DataFrame, lineitem: DataFrame, customer: DataFrame,
                      grain_hours: int = ORDER_LINE_GRAIN_HOURS, p: Params = Params()) -> DataFrame:
    """Health series (same schema as ``rollup.health_rollup``) of the order-line attempts."""
    o = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
                      F.col("o_orderpriority").alias("payment_method"))
    c = maybe_broadcast(customer.select(F.col("c_custkey").alias("o_custkey"),
                                        F.col("c_mktsegment").alias("bank_gateway")),
                        p.broadcast_max_rows, p.broadcast_max_bytes)
    j = (per_order(lineitem).join(o, "o_orderkey").join(c, "o_custkey")
         .where(F.col("payment_method").isNotNull() & F.col("bank_gateway").isNotNull() & F.col("ts").isNotNull()))
    agg = j.groupBy("payment_method", "bank_gateway", F.window("ts", f"{int(grain_hours)} hours").alias("cell")).agg(
        F.sum("n").alias("transaction_volume"),
        F.sum("n_ok").alias("n_ok"),
        F.sum("n_known").alias("n_known"),
        F.sum("lat_sum").alias("lat_sum"),
        F.sum("n_lat").alias("n_lat"),
    )
    return agg.select(
        F.col("cell.start").alias("ts"),
        "payment_method",
        "bank_gateway",
        safe_div(F.col("n_ok"), F.col("n_known")).alias("success_rate"),
        safe_div(F.col("lat_sum"), F.col("n_lat")).alias("avg_latency_ms"),
        F.col("transaction_volume").cast("bigint").alias("transaction_volume"),
    )


def order_line_health_tables(spark: SparkSession, sf_dir: str, grain_hours: int = ORDER_LINE_GRAIN_HOURS,
                             p: Params = Params()) -> DataFrame:
    return order_line_health(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"),
                             read_table(spark, sf_dir, "customer"), grain_hours, p)
