"""Success probability per action, a reproducible success draw, and money accounting.

Money is carried in integer paise (cents) so that every sum is exact and independent of the
order rows are added; rupee columns are derived as ``paise / 100``.

The draw replaces a sequential random generator by a hash of (transaction, policy, seed):
``u = first 32 bits of md5 / 2^32``. It does not depend on partitioning or row order, so a rerun
or a retried task reproduces the same outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewatch.functions.numeric import clip
from slicewatch.functions.timeutil import epoch_micros
from slicewatch.params import Params


def probability_expr(p: Params = Params(), action: str = "allowed_action", pct: str = "final_discount_pct") -> Column:
    a = F.col(action)
    now = F.coalesce(F.col("ground_truth_recovery_probability"), F.lit(0.0))
    after = F.coalesce(F.col("ground_truth_recovery_probability_after_recovery"), now)
    linked = F.coalesce(F.col("degradation_linked"), F.lit(False))
    cap = p.probability_cap
    discount = clip(now + F.lit(p.discount_uplift) * (F.coalesce(F.col(pct), F.lit(0)) / F.lit(15.0)), 0.0, cap)
    return (
        F.when(a == "give_up", F.lit(0.0))
        .when(a == "retry_now", now)
        .when(a == "retry_delayed", F.when(linked, after).otherwise(clip(now + F.lit(p.delayed_uplift), 0.0, cap)))
        .when(a == "reroute_gateway", F.when(linked, after).otherwise(clip(now + F.lit(p.reroute_uplift), 0.0, cap)))
        .when(a == "send_discount", discount)
        .when(a == "send_reminder", clip(now + F.lit(p.reminder_uplift), 0.0, cap))
        .when(a == "escalate", clip(now + F.lit(p.escalate_uplift), 0.0, cap))
        .otherwise(now)
    )


def draw_expr(seed: str, id_col: str = "transaction_id", policy_col: str = "policy") -> Column:
    h = F.md5(F.concat_ws("|", F.col(id_col), F.col(policy_col), F.lit(seed)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def with_outcome(enforced: DataFrame, p: Params = Params(), mode: str = "draw") -> DataFrame:
    """Adds probability_used, success, paise columns and rupee columns.

    ``mode="draw"`` decides success with the hash draw; ``mode="observed"`` reads it from the column
    ``observed_success`` (unknown counts as not recovered; giving up recovers nothing); ``mode="expected"`` leaves
    ``success`` null and reports the expected recovered amount (probability × amount) instead.
    """
    a = F.col("allowed_action")
    prob = probability_expr(p)
    df = enforced.withColumn("probability_used", prob)
    amount_paise = F.round(F.col("amount") * F.lit(100.0), 0).cast("bigint")
    cost_paise = F.when(a == "give_up", F.lit(0)).otherwise(F.lit(int(round(p.action_cost * 100)))).cast("bigint")
    pct = F.coalesce(F.col("final_discount_pct"), F.lit(0)).cast("bigint")
    if mode == "expected":
        exp = F.col("probability_used") * F.col("amount")
        return df.withColumns({
            "success": F.lit(None).cast("boolean"),
            "expected_recovered": exp,
            "action_cost": cost_paise / F.lit(100.0),
        })
    if mode == "observed":
        success = (a != "give_up") & F.coalesce(F.col("observed_success"), F.lit(False))
    else:
        df = df.withColumn("u", draw_expr(p.draw_seed))
        success = (a != "give_up") & (F.col("u") < F.col("probability_used"))
    df = df.withColumn("success", success)
    rec = F.when(F.col("success"), amount_paise).otherwise(F.lit(0)).cast("bigint")
    # half-up rounding of amount * pct / 100 in integer arithmetic
    disc = F.when(F.col("success") & (a == "send_discount"), F.floor((rec * pct + F.lit(50)) / F.lit(100))).otherwise(F.lit(0)).cast("bigint")
    df = df.withColumns({"recovered_paise": rec, "discount_paise": disc, "cost_paise": cost_paise})
    df = df.withColumn("net_paise", F.col("recovered_paise") - F.col("discount_paise") - F.col("cost_paise"))
    return df.withColumns({
        "amount_recovered": F.col("recovered_paise") / F.lit(100.0),
        "discount_cost": F.col("discount_paise") / F.lit(100.0),
        "action_cost": F.col("cost_paise") / F.lit(100.0),
        "net_recovered": F.col("net_paise") / F.lit(100.0),
    })


def observed_recoveries(attempts: DataFrame, within_hours: int = 24) -> DataFrame:
    """``transaction_id, observed_success``: whether the user of a failed attempt paid successfully later, within
    ``within_hours``. Read from the attempts themselves.

    Times are cut into chunks of that length, so the success lies in the attempt's chunk or the next one: a running
    minimum per (user, chunk) in falling time, and one row per (user, chunk) for the next. A busy user
    spreads over their chunks."""
    size = int(within_hours) * 3_600_000_000
    at = epoch_micros("ts")
    a = attempts.select("attempt_id", "user_id", "ok", at.alias("at"), F.call_function("div", at - F.pmod(at, F.lit(size)), F.lit(size)).alias("chunk"))
    good = F.when(F.col("ok"), F.col("at"))
    later = Window.partitionBy("user_id", "chunk").orderBy(-F.col("at")).rangeBetween(Window.unboundedPreceding, -1)
    here = a.withColumn("_next", F.min(good).over(later)).where(~F.col("ok"))
    first = a.where("ok").groupBy("user_id", (F.col("chunk") - 1).alias("chunk")).agg(F.min("at").alias("_first"))
    next_ok = F.coalesce("_next", "_first")
    return here.join(first, ["user_id", "chunk"], "left").select(
        F.col("attempt_id").cast("string").alias("transaction_id"),
        F.coalesce(next_ok - F.col("at") <= F.lit(size), F.lit(False)).alias("observed_success"))


def expected_outcomes(enforced: DataFrame, p: Params = Params()) -> DataFrame:
    return with_outcome(enforced, p, mode="expected")
