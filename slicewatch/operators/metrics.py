"""Policy metrics per segment and agent-vs-baseline deltas.

The rows are summed once per (policy, linked); GROUPING SETS ((policy), (policy, linked)) then add up
those few sums, so no outcome row is expanded. The policies of the data come from the same sums, and every policy is
given all segments: empty groups become zero rows (D8) without reading the outcomes again. Ratios are
guarded (D9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.functions.numeric import round_double

SEGMENTS = ("overall", "degradation_linked", "non_degradation_linked")
METRIC_COLUMNS = (
    "policy", "segment", "total_transactions", "successes", "recovery_rate_pct",
    "total_revenue_recovered_rs", "net_revenue_recovered_rs", "total_cost_rs",
    "cost_to_recover_per_100", "escalation_count",
)


def policy_metrics(outcomes: DataFrame, policies: tuple[str, ...] = ("agent", "baseline")) -> DataFrame:
    """``outcomes`` needs policy, degradation_linked, success, allowed_action and the paise columns."""
    o = outcomes.withColumn("linked", F.coalesce(F.col("degradation_linked"), F.lit(False)))
    sums = o.groupBy("policy", "linked").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("success")).alias("successes"),
        F.sum(F.when(F.col("success"), F.col("recovered_paise")).otherwise(0)).alias("gross_p"),
        F.sum("net_paise").alias("net_p"),
        F.sum(F.col("discount_paise") + F.col("cost_paise")).alias("cost_p"),
        F.count_if(F.col("allowed_action") == "escalate").alias("escalation_count"),
    )
    values = [c for c in sums.columns if c not in ("policy", "linked")]
    g = sums.where(F.col("policy").isNotNull()).groupingSets([["policy"], ["policy", "linked"]], "policy", "linked").agg(
        *[F.sum(c).alias(c) for c in values], F.grouping_id().alias("gid"))
    own = F.when(F.col("gid") == 1, "overall").when(F.col("linked"), "degradation_linked").otherwise("non_degradation_linked")
    # every policy of the data, and the given ones even without rows, in every segment
    segments = F.explode(F.array(*[F.lit(x) for x in SEGMENTS])).alias("segment")
    seen = g.withColumn("own", own).select("policy", "own", segments, *values).select(
        "policy", "segment", *[F.when(F.col("own") == F.col("segment"), F.col(c)).alias(c) for c in values])
    given = outcomes.sparkSession.createDataFrame([(pol,) for pol in policies], "policy string").select("policy", segments)
    j = seen.unionByName(given, allowMissingColumns=True).groupBy("policy", "segment").agg(*[F.max(c).alias(c) for c in values])
    total = F.coalesce(F.col("total_transactions"), F.lit(0))
    succ = F.coalesce(F.col("successes"), F.lit(0))
    gross = F.coalesce(F.col("gross_p"), F.lit(0))
    cost = F.coalesce(F.col("cost_p"), F.lit(0))
    return j.select(
        "policy",
        "segment",
        total.cast("bigint").alias("total_transactions"),
        succ.cast("bigint").alias("successes"),
        F.when(total > 0, round_double(succ * F.lit(100.0) / total, 2)).otherwise(0.0).alias("recovery_rate_pct"),
        (gross / F.lit(100.0)).alias("total_revenue_recovered_rs"),
        (F.coalesce(F.col("net_p"), F.lit(0)) / F.lit(100.0)).alias("net_revenue_recovered_rs"),
        (cost / F.lit(100.0)).alias("total_cost_rs"),
        F.when(gross > 0, round_double(cost * F.lit(100.0) / gross, 2)).otherwise(0.0).alias("cost_to_recover_per_100"),
        F.coalesce(F.col("escalation_count"), F.lit(0)).cast("bigint").alias("escalation_count"),
    )


def policy_comparison(metrics: DataFrame, a: str = "agent", b: str = "baseline") -> DataFrame:
    """D10 + J4: four deltas of rounded values; null unless both policies have rows."""
    def pick(policy: str, segment: str, col: str):
        return F.max(F.when((F.col("policy") == policy) & (F.col("segment") == segment), F.col(col)))

    m = metrics.agg(
        pick(a, "overall", "net_revenue_recovered_rs").alias("a_net"),
        pick(b, "overall", "net_revenue_recovered_rs").alias("b_net"),
        pick(a, "overall", "recovery_rate_pct").alias("a_rate"),
        pick(b, "overall", "recovery_rate_pct").alias("b_rate"),
        pick(a, "degradation_linked", "recovery_rate_pct").alias("a_lrate"),
        pick(b, "degradation_linked", "recovery_rate_pct").alias("b_lrate"),
        pick(a, "degradation_linked", "net_revenue_recovered_rs").alias("a_lnet"),
        pick(b, "degradation_linked", "net_revenue_recovered_rs").alias("b_lnet"),
        pick(a, "overall", "total_transactions").alias("a_n"),
        pick(b, "overall", "total_transactions").alias("b_n"),
    )
    has_run = (F.col("a_n") > 0) & (F.col("b_n") > 0)
    return m.select(
        F.when(has_run, round_double(F.col("a_net") - F.col("b_net"), 2)).alias("net_revenue_delta_rs"),
        F.when(has_run, round_double(F.col("a_rate") - F.col("b_rate"), 2)).alias("recovery_rate_delta_pct_points"),
        F.when(has_run, round_double(F.col("a_lrate") - F.col("b_lrate"), 2)).alias("degradation_linked_recovery_rate_delta_pct_points"),
        F.when(has_run, round_double(F.col("a_lnet") - F.col("b_lnet"), 2)).alias("degradation_linked_net_revenue_delta_rs"),
    )


def recovery_chart(metrics: DataFrame, a: str = "agent", b: str = "baseline") -> DataFrame:
    """Chart rows, one per segment, with net recovered and recovery rate of both policies side by
    side (a pivot of the metrics on the policy; the value list is given, so no distinct job)."""
    return metrics.groupBy("segment").pivot("policy", [a, b]).agg(
        F.max("net_revenue_recovered_rs").alias("net_rs"), F.max("recovery_rate_pct").alias("rate_pct"))
