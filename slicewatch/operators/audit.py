"""Audit trail rows fanned out from the wide run frame, and its read view.

One executed decision yields four rows (decision, rule_check, action, outcome) plus an
``escalation`` row when the allowed action is ``escalate``; a skipped decision yields one
``action`` row; each detected event yields one ``pipeline`` row. ``detail`` is JSON text built
with ``to_json(named_struct(...))``. Rows are ordered by (batch_seq, seq, transaction_id, ordinal); newest = largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("decision", "rule_check", "action", "escalation", "outcome")
AUDIT_COLUMNS = ("batch_seq", "seq", "transaction_id", "ordinal", "policy", "stage", "detail")
# newest first = descending on this key
LOG_ORDER = ("batch_seq", "seq", "transaction_id", "ordinal")


def _row(stage: str, ordinal: int, detail: F.Column, cond: F.Column | None = None) -> F.Column:
    s = F.struct(F.lit(stage).alias("stage"), F.lit(ordinal).alias("ordinal"), F.to_json(detail).alias("detail"))
    return s if cond is None else F.when(cond, s)


def audit_rows(wide: DataFrame, seq_col: str = "seq", batch_col: str = "batch_seq") -> DataFrame:
    """``wide`` is the output of ``plans.run.run_policy`` (one row per decision with ``status``)."""
    execd = F.col("status") == "execute"
    rule = F.struct(
        F.col("allowed_action"), F.col("allowed"), F.col("block_reason"),
        F.col("final_delay_hours").alias("delay_hours"), F.col("final_discount_pct").alias("discount_pct"),
    )
    decision = F.struct("transaction_id", "decision", "reasoning", "confidence", "delay_hours", "discount_pct")
    action = F.struct(F.col("allowed_action").alias("action_type"), F.col("allowed"), F.col("block_reason"),
                      F.col("final_delay_hours").alias("delay_hours"), F.col("final_discount_pct").alias("discount_pct"))
    escalation = F.struct(
        F.coalesce(F.col("block_reason"), F.lit("agent_decision")).alias("reason"), "failure_type", "amount")
    outcome = F.struct(
        F.col("allowed_action").alias("action_type"), "success", "amount_recovered", "discount_cost",
        "action_cost", "net_recovered", F.round("probability_used", 4).alias("probability_used"))
    skipped = F.struct(F.col("status").alias("action_type"), F.coalesce(F.col("invalid_reason"), F.col("status")).alias("reason"))
    rows = F.filter(F.array(
        _row("decision", 0, decision, execd),
        _row("rule_check", 1, rule, execd),
        _row("action", 2, action, execd),
        _row("escalation", 3, escalation, execd & (F.col("allowed_action") == "escalate")),
        _row("outcome", 4, outcome, execd),
        _row("action", 0, skipped, ~execd),
    ), lambda x: x.isNotNull())
    ex = wide.select("transaction_id", "policy", F.col(batch_col).alias("batch_seq"), F.col(seq_col).alias("seq"),
                     F.explode(rows).alias("r"))
    return ex.select(
        F.col("batch_seq").cast("bigint").alias("batch_seq"), F.col("seq").cast("bigint").alias("seq"),
        "transaction_id", F.col("r.ordinal").alias("ordinal"), "policy",
        F.col("r.stage").alias("stage"), F.col("r.detail").alias("detail"),
    )


def event_audit_rows(events_rc: DataFrame) -> DataFrame:
    detail = F.struct(
        F.lit("degradation_event_detected").alias("action"),
        F.struct("payment_method", "bank_gateway", "window_start", "window_end", "baseline_rate",
                 "current_rate", "severity", "z_score").alias("event"),
        F.col("root_cause_statement").alias("root_cause"),
        "classification",
    )
    return events_rc.select(
        F.lit(-1).cast("bigint").alias("batch_seq"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.lit(None).cast("string").alias("transaction_id"),
        F.lit(0).alias("ordinal"),
        F.lit(None).cast("string").alias("policy"),
        F.lit("pipeline").alias("stage"),
        F.to_json(detail).alias("detail"),
    )


def escalations(wide: DataFrame) -> DataFrame:
    """One record per executed escalate action."""
    return wide.where((F.col("status") == "execute") & (F.col("allowed_action") == "escalate")).select(
        "transaction_id", "policy",
        F.coalesce(F.col("block_reason"), F.lit("agent_decision")).alias("reason"),
        "failure_type", "amount",
    )


def audit_view(audit: DataFrame, transaction_id: str | None = None, stage: str | None = None,
               policy: str | None = None, limit: int | None = None, offset: int = 0,
               before: tuple | None = None) -> DataFrame:
    """I14 (B4 + F5): optional equality filters, newest first; all rows unless a limit
    is given, then limit/offset paging.

    ``before`` = the ``LOG_ORDER`` key of the last row of the previous page switches to keyset
    paging (rows strictly older, ``offset`` ignored): each task keeps ``limit`` rows however deep
    the page. A null transaction id (event rows, batch -1) sorts last, as in the ordering."""
    df = audit
    for name, val in (("transaction_id", transaction_id), ("stage", stage), ("policy", policy)):
        if val:
            df = df.where(F.col(name) == F.lit(val))
    if before is not None:
        b, q, t, o = before
        bs, sq, od = F.col("batch_seq"), F.col("seq"), F.col("ordinal")
        tid = F.col("transaction_id")
        # transaction id "older" than t under DESC NULLS LAST: smaller, or null when t is not null
        t_older = tid.isNull() if t is None else (tid.isNull() | F.coalesce(tid < F.lit(t), F.lit(False)))
        t_same = tid.isNull() if t is None else F.coalesce(tid == F.lit(t), F.lit(False))
        older = ((bs < F.lit(b)) | ((bs == F.lit(b)) & ((sq < F.lit(q)) | ((sq == F.lit(q)) & (
            (t_older & ~t_same) | (t_same & (od < F.lit(o))))))))
        df = df.where(F.coalesce(older, F.lit(False)))
        offset = 0
    out = df.orderBy(*[F.col(c).desc_nulls_last() for c in LOG_ORDER])
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(int(limit))


def parse_detail(audit: DataFrame) -> DataFrame:
    """H10 decode: VARIANT when the text is JSON, the raw text stays in ``detail`` otherwise."""
    return audit.withColumn("detail_json", F.try_parse_json("detail"))


def export_audit(audit: DataFrame, path: str) -> None:
    """JSON lines, newest first within the written order."""
    audit.orderBy(*[F.col(c).desc_nulls_last() for c in LOG_ORDER]).write.mode("overwrite").json(path)
