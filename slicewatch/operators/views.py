"""Read views over the run tables: B4, B7, C4-C6, D12, D17, F1-F5, F7, J1, J5, J6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_by(df: DataFrame, **eq) -> DataFrame:
    """Equality filters applied only for the arguments that are given."""
    for name, val in eq.items():
        if val is not None and val != "":
            df = df.where(F.col(name) == F.lit(val))
    return df


def timeseries_page(health: DataFrame, payment_method=None, bank_gateway=None, limit: int | None = None,
                    after: tuple | None = None) -> DataFrame:
    """series by ts ascending (slice as tie-break). All rows, or pages of ``limit`` rows (a top-k):
    ``after`` = (ts, method, gateway) of the last row of the page before."""
    df = filter_by(health, payment_method=payment_method, bank_gateway=bank_gateway)
    if after is not None:
        key = F.struct("ts", "payment_method", "bank_gateway")
        last = F.struct(F.lit(after[0]).cast("timestamp_ntz").alias("ts"), F.lit(after[1]).alias("payment_method"),
                        F.lit(after[2]).alias("bank_gateway"))
        df = df.where(key > last)
    out = df.orderBy("ts", "payment_method", "bank_gateway")
    return out if limit is None else out.limit(int(limit))


def slice_catalog(health: DataFrame) -> DataFrame:
    """D17 + G3: distinct methods and gateways (kind, name), sorted."""
    m = health.select(F.lit("payment_method").alias("kind"), F.col("payment_method").alias("name")).distinct()
    g = health.select(F.lit("bank_gateway").alias("kind"), F.col("bank_gateway").alias("name")).distinct()
    return m.unionByName(g).orderBy("kind", "name")


def event_list(events: DataFrame, payment_method=None, limit: int | None = None) -> DataFrame:
    """F2 (+ J2 filter half); F8: ``limit`` keeps the first events only (a top-k)."""
    out = filter_by(events, payment_method=payment_method).orderBy("window_start", "event_id")
    return out.limit(int(limit)) if limit is not None else out


def health_pivot(health: DataFrame, payment_method: str, value: str = "success_rate",
                 gateways: list[str] | None = None) -> DataFrame:
    """One row per ts, one column per gateway of one method.

    With ``gateways`` given the pivot is a single aggregation; without, Spark first runs a distinct
    job for the column names (bounded by ``spark.sql.pivotMaxValues``)."""
    g = filter_by(health, payment_method=payment_method).groupBy("ts")
    return (g.pivot("bank_gateway", list(gateways)) if gateways is not None else g.pivot("bank_gateway")).agg(F.first(value))


def decisions_table(wide: DataFrame) -> DataFrame:
    x = wide.where(F.col("status") == "execute")
    return x.select(
        F.concat_ws(":", "policy", "transaction_id").alias("decision_id"),
        "transaction_id", "policy", "decision", "reasoning", "confidence", "delay_hours", "discount_pct",
        F.coalesce(F.col("degradation_linked"), F.lit(False)).alias("degradation_linked"), "event_id", "batch_seq", "seq",
        F.col("ts").alias("txn_ts"),          # transaction time: the feed is ordered without a join
    )


def actions_table(wide: DataFrame) -> DataFrame:
    x = wide.where(F.col("status") == "execute")
    key = F.concat_ws(":", "policy", "transaction_id")
    return x.select(key.alias("action_id"), key.alias("decision_id"), "transaction_id", "policy",
                    F.col("allowed_action").alias("action_type"), "allowed", "block_reason")


def transaction_day(ts: str) -> Column:
    """Day of a transaction; those without a time share the first day of the calendar, so that the day is
    always an equi-key."""
    return F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date"))


def outcomes_table(wide: DataFrame) -> DataFrame:
    x = wide.where(F.col("status") == "execute")
    key = F.concat_ws(":", "policy", "transaction_id")
    return x.select(key.alias("outcome_id"), key.alias("action_id"), "transaction_id", "policy", "success",
                    "amount_recovered", "discount_cost", "action_cost", "net_recovered",
                    "recovered_paise", "discount_paise", "cost_paise", "net_paise",
                    transaction_day("ts").alias("date"))    # partition column when stored


def transactions_table(linked: DataFrame) -> DataFrame:
    return linked.select(
        "transaction_id", "payment_method", "bank_gateway", "ts", "amount", "customer_id", "customer_history",
        "retry_count_so_far", "failure_type", "degradation_linked", "ground_truth_recovery_probability",
        "ground_truth_recovery_probability_after_recovery",
    )


def metrics_base(outcomes: DataFrame, actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcomes ⨝ actions ⨝ decisions (input of policy_metrics). All three have one row per decision, so
    none is sent whole to every task, however small its file looks."""
    o = outcomes.select("action_id", "transaction_id", "policy", "success", "recovered_paise", "discount_paise",
                        "cost_paise", "net_paise")
    a = actions.select("action_id", "decision_id", F.col("action_type").alias("allowed_action"))
    d = decisions.select("decision_id", "decision", "degradation_linked")
    return o.join(a.hint("merge"), "action_id").join(d.hint("merge"), "decision_id")


def decision_feed(decisions: DataFrame, txns: DataFrame, actions: DataFrame, outcomes: DataFrame,
                  policy=None, degradation_linked=None, page: int = 1, page_size: int = 25,
                  broadcast_max_rows: int = 1_000_000, after: tuple | None = None) -> DataFrame:
    """C4 + F3 + J6: newest decision first, LIMIT/OFFSET paging (order: ts, id, policy desc).

    ``after`` = (ts, transaction_id, policy) of the last row of the previous page switches to keyset
    paging: rows strictly after that key, ``page`` ignored. Each task then keeps ``page_size`` rows
    however deep the page, where OFFSET keeps offset + size.

    The page is chosen first, on the decisions alone (they carry the transaction time): a
    top-(offset + size) of (decision id, transaction id, policy, time) with the offset dropped, written once.
    Only the page's rows are then fetched from the four tables, with the page (at most
    ``page_size`` rows) broadcast into each scan, so no full-width table is shuffled. Exact because
    every decision has at most one action and every action at most one outcome (their ids are the
    decision key).
    """
    order = [F.col("ts").desc(), F.col("transaction_id").desc(), F.col("policy").desc()]
    d = filter_by(decisions, policy=policy, degradation_linked=degradation_linked)
    keys = d.select("decision_id", "transaction_id", "policy", F.col("txn_ts").alias("ts"))
    if after is not None:
        a_ts, a_id, a_pol = (F.lit(v) for v in after)
        ts, tid, pol = F.col("ts"), F.col("transaction_id"), F.col("policy")
        keys = keys.where((ts < a_ts) | ((ts == a_ts) & ((tid < a_id) | ((tid == a_id) & (pol < a_pol)))))
        skip = 0
    else:
        skip = (max(int(page), 1) - 1) * int(page_size)
    chosen = keys.orderBy(*order).offset(skip).limit(int(page_size)).select("decision_id", "transaction_id")

    # the page (at most page_size rows) is written once, so the key join and top-k run once; it is
    # then broadcast into every scan
    from slicewatch.session import cut_lineage
    page = cut_lineage(chosen, "feed-page")
    page_b = F.broadcast(page) if int(page_size) <= broadcast_max_rows else page
    pd_ = d.join(page_b, ["decision_id", "transaction_id"], "left_semi")
    pt = txns.select("transaction_id", "ts", "amount", "failure_type", "customer_history", "payment_method",
                     "bank_gateway").join(page_b, "transaction_id", "left_semi")
    pa = actions.select("decision_id", "action_id", "action_type", "allowed", "block_reason").join(
        page_b, "decision_id", "left_semi")
    po = outcomes.select("action_id", "success", "amount_recovered", "net_recovered").join(
        actions.select("decision_id", "action_id").join(page_b, "decision_id", "left_semi"), "action_id", "left_semi")
    j = pd_.join(pt, "transaction_id").join(pa, "decision_id", "left").join(po, "action_id", "left")
    j = j.withColumn("overridden", ~F.coalesce(F.col("allowed"), F.lit(True)) & F.col("block_reason").isNotNull())
    return j.orderBy(*order)


def feed_total(decisions: DataFrame, policy=None, degradation_linked=None, page_size: int = 25) -> DataFrame:
    """D12 + J5: filtered total and page count (at least 1)."""
    d = filter_by(decisions, policy=policy, degradation_linked=degradation_linked)
    return d.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(page_size)))).cast("bigint"))


def escalation_queue(decisions: DataFrame, txns: DataFrame, actions: DataFrame, policy="agent") -> DataFrame:
    """C6 + F4 + B7: escalated decisions with transaction facts, largest amount first."""
    d = filter_by(decisions, policy=policy).select("decision_id", "transaction_id", "policy", "reasoning", "confidence")
    t = txns.select("transaction_id", "amount", "failure_type", "customer_history", "payment_method",
                    "bank_gateway", "retry_count_so_far")
    a = actions.where(F.col("action_type") == "escalate").select("decision_id", "block_reason")
    return d.join(t, "transaction_id").join(a, "decision_id").orderBy(F.col("amount").desc(), "transaction_id")


def sample_per_group(linked: DataFrame, n_linked: int = 3, n_unlinked: int = 2) -> DataFrame:
    """first n transactions per linkage group (by time, then id).

    Two groups only, so a window partitioned by the flag would put each whole group in one task;
    instead each group is a bounded top-k (TakeOrdered: per-task top n, then a final merge)."""
    w = Window.orderBy("ts", "transaction_id")
    parts = []
    for flag, n in ((True, n_linked), (False, n_unlinked)):
        top = linked.where(F.col("degradation_linked") == F.lit(flag)).orderBy("ts", "transaction_id").limit(n)
        parts.append(top.withColumn("rn", F.row_number().over(w)))   # ranks n rows only
    return parts[0].unionByName(parts[1])


def batch_results(wide: DataFrame) -> DataFrame:
    """What a policy run returns, one row per decision: id, policy, linkage, decision, routing
    status, the action allowed by the rules and its outcome (null when the decision was skipped)."""
    return wide.select("transaction_id", "policy",
                       F.coalesce(F.col("degradation_linked"), F.lit(False)).alias("degradation_linked"),
                       "decision", "status", "allowed_action", "success", "net_recovered")
