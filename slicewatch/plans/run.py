"""Steps 5-7 for one policy: decide → validate/route → stopping rules → outcome, as one wide frame.

The wide frame (one row per decision, with ``status``) feeds every sink — decisions, actions,
outcomes, escalations, audit — as projections; persist or write it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.functions.timeutil import epoch_micros
from slicewatch.operators.outcomes import with_outcome
from slicewatch.operators.policies import baseline_policy, rule_policy
from slicewatch.operators.rules import enforce
from slicewatch.operators.validate import mark_done, route
from slicewatch.params import ALLOWED_DECISIONS, Params
from slicewatch.session import cut_lineage

TXN_COLUMNS = (
    "transaction_id", "payment_method", "bank_gateway", "ts", "amount", "customer_id", "customer_history",
    "retry_count_so_far", "failure_type", "degradation_linked", "event_id",
    "ground_truth_recovery_probability", "ground_truth_recovery_probability_after_recovery",
)
OUTCOME_COLUMNS = ("probability_used", "u", "success", "recovered_paise", "discount_paise", "cost_paise",
                   "net_paise", "amount_recovered", "discount_cost", "action_cost", "net_recovered")


def validate_typed(decisions: DataFrame) -> DataFrame:
    """I6 for decisions that are already typed columns (built-in policies)."""
    problems = F.concat_ws(
        "; ",
        F.when(F.col("transaction_id").isNull(), F.lit("transaction_id must be a string")),
        F.when(F.col("decision").isNull(), F.lit("decision must be a string")),
        F.when(F.col("reasoning").isNull(), F.lit("reasoning must be a string")),
        F.when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1),
               F.lit("confidence must be within [0, 1]")),
        F.when(F.col("decision").isNotNull() & ~F.col("decision").isin(*ALLOWED_DECISIONS),
               F.lit("decision is not an allowed value")),
    )
    return decisions.withColumn("invalid_reason", F.nullif(problems, F.lit(""))).withColumn(
        "is_valid", F.col("invalid_reason").isNull())


def policy_decisions(policy: str, linked: DataFrame, p: Params = Params(), keep_input: bool = False) -> DataFrame:
    """Decision rows of a built-in policy; ``seq`` (batch order) = transaction time in µs."""
    src = linked.withColumn("seq", epoch_micros("ts"))
    if policy == "baseline":
        d = baseline_policy(src, p, keep_input=True)
    else:
        d = rule_policy(src, p, policy=policy, keep_input=True)
    d = validate_typed(d)
    if not keep_input:
        d = d.select("seq", "transaction_id", "policy", "decision", "reasoning", "confidence",
                     "delay_hours", "discount_pct", "is_valid", "invalid_reason")
    return d


def run_builtin(policy: str, linked: DataFrame, p: Params = Params(),
                prior_outcomes: DataFrame | None = None, batch_seq: int = 0) -> DataFrame:
    """Wide frame for a built-in policy: decisions are columns of the transaction rows, so no
    decision ↔ transaction join is needed (one decision per transaction by construction)."""
    d = policy_decisions(policy, linked, p, keep_input=True)
    d = mark_done(d, prior_outcomes)
    again = F.col("_again") if "_again" in d.columns else F.lit(False)
    status = (F.when(~F.col("is_valid"), "skipped_invalid_decision_schema")
              .when(F.coalesce(F.col("_done"), F.lit(False)) | again, "skipped_duplicate")
              .otherwise("execute"))
    d = d.withColumn("status", status).drop("_done", "_again")
    return _finish(d, p, batch_seq)


def mark_repeats(linked: DataFrame) -> DataFrame:
    """``_again`` = a row that repeats a transaction id of the same batch (all but the first by time, then
    content). Only rows of repeated ids are written with a row number; the first of an id is a partial minimum, so a hot id
    spreads over tasks. A batch of unique ids costs one thin aggregate."""
    repeated = linked.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("transaction_id").isNotNull() & (F.col("_n") > 1)).select("transaction_id")
    if not repeated.limit(1).count():
        return linked
    rows = cut_lineage(linked.join(repeated, "transaction_id", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "repeats")
    place = F.struct("ts", F.xxhash64(*linked.columns).alias("content"), "_row")
    firsts = rows.groupBy("transaction_id").agg(F.min(place).alias("_min")).select(F.col("_min._row").alias("_row"), F.lit(False).alias("_again"))
    ranked = rows.join(firsts, "_row", "left").select(*linked.columns, F.coalesce("_again", F.lit(True)).alias("_again"))
    alone = linked.join(repeated, "transaction_id", "left_anti").withColumn("_again", F.lit(False))
    return alone.unionByName(ranked)


def _finish(routed: DataFrame, p: Params, batch_seq: int) -> DataFrame:
    # The rule result and the outcome stand in an array of one struct: a higher-order function ends a generated method,
    # which with all the columns in it has more than the 8,000 bytes of code that the JVM compiles at most.
    ruled = enforce(routed, p)
    rule = ("allowed_action", "allowed", "block_reason", "final_delay_hours", "final_discount_pct")
    held = F.transform(F.array(F.struct(*rule)), lambda x: x)
    out = with_outcome(ruled.withColumn("_rule", held).select(
        *[c for c in ruled.columns if c not in rule], *[F.col("_rule")[0][c].alias(c) for c in rule]), p)
    execd = F.col("status") == "execute"
    done = F.filter(F.array(F.struct(*rule, *OUTCOME_COLUMNS)), lambda x: execd)
    out = out.withColumn("_done", done)
    return out.withColumns({c: F.get("_done", F.lit(0))[c] for c in rule + OUTCOME_COLUMNS}).drop("_done").withColumn(
        "batch_seq", F.lit(batch_seq).cast("bigint"))


def run_policy(decisions: DataFrame, linked: DataFrame, p: Params = Params(),
               prior_outcomes: DataFrame | None = None, batch_seq: int = 0) -> DataFrame:
    """Wide frame: decision + status + transaction + rule result + outcome (outcome null if skipped)."""
    txn = linked.select(*[c for c in TXN_COLUMNS if c in linked.columns])
    return _finish(route(decisions, txn, prior_outcomes), p, batch_seq)


def run_all(linked: DataFrame, p: Params = Params(), policies=("baseline", "agent"),
            prior_outcomes: DataFrame | None = None) -> DataFrame:
    """Both policies' wide frames in one table (baseline batch first, as in a demo run)."""
    linked = mark_repeats(linked)
    frames = [run_builtin(pol, linked, p, prior_outcomes, batch_seq=i) for i, pol in enumerate(policies)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def executed(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("status") == "execute")
