"""Physical plan shape (no nested-loop or cartesian joins, pruned scans, pushed filters) and the
page-first decision feed against a brute-force full join."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slicewatch.operators import views
from slicewatch.operators.events import detect_events
from slicewatch.operators.linkage import link
from slicewatch.operators.rollup import health_rollup
from slicewatch.operators.root_cause import root_cause
from slicewatch.params import Params
from slicewatch.plans.run import run_all
from slicewatch.sources.payments import attempts, transactions

SF = "/root/testdata/sf0.001"
P = Params(grain_hours=24, healthy_threshold=0.6)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _no_loop_joins(plan: str) -> None:
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, plan


def test_rollup_scan_reads_only_needed_columns(spark):
    plan = _plan(health_rollup(attempts(spark, SF), 24))
    schema = plan[plan.index("ReadSchema: struct<"):].split(">", 1)[0]
    assert "event_id" not in schema
    assert all(c in schema for c in ("ts", "user_id", "event_type", "value", "props"))


def test_failed_attempt_filter_reaches_the_scan(spark):
    plan = _plan(transactions(spark, SF))
    pushed = plan[plan.index("PushedFilters:"):].split("]", 1)[0]
    assert "event_type" in pushed, pushed


def test_root_cause_and_linkage_plans_are_equi_joins(spark):
    health = health_rollup(attempts(spark, SF), 24)
    events = detect_events(health, P)
    _no_loop_joins(_plan(root_cause(events, health, P)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(link(transactions(spark, SF), events, P, broadcast_check=False))
        _no_loop_joins(plan)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_decision_feed_pages_equal_full_join(spark, txn_df):
    rows = [(f"t{i:02d}", "upi", "gw_a", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=(i * 7) % 40), 100.0 + i, "c",
             ["new", "repeat", "high_value", "at_risk"][i % 4], i % 4, ["bank_decline", "gateway_timeout"][i % 2],
             bool(i % 3 == 0), 0.5, 0.5) for i in range(30)]
    txns = txn_df(rows).withColumn("event_id", F.when(F.col("degradation_linked"), F.lit(1)).cast("bigint"))
    w = run_all(txns, P)
    d, a, o = views.decisions_table(w), views.actions_table(w), views.outcomes_table(w)
    t = views.transactions_table(txns)
    full = (d.where(F.col("policy") == "agent").join(t, "transaction_id")
            .join(a.select("decision_id", "action_id", "action_type", "allowed", "block_reason"), "decision_id", "left")
            .join(o.select("action_id", "success", "net_recovered"), "action_id", "left")
            .orderBy(F.col("ts").desc(), F.col("transaction_id").desc(), F.col("policy").desc())
            .select("decision_id").collect())
    want = [r.decision_id for r in full]
    after = None
    for page in (1, 2, 3):
        got = views.decision_feed(d, t, a, o, policy="agent", page=page, page_size=12).collect()
        assert [r.decision_id for r in got] == want[(page - 1) * 12: page * 12]
        keyset = views.decision_feed(d, t, a, o, policy="agent", page_size=12, after=after).collect()
        assert [r.decision_id for r in keyset] == [r.decision_id for r in got]
        if got:
            after = (got[-1].ts, got[-1].transaction_id, got[-1].policy)


def test_broadcast_needs_both_row_and_byte_bounds(spark):
    from slicewatch.operators.linkage import maybe_broadcast
    df = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), 50).alias("pad"))

    def hinted(d) -> bool:
        return "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(maybe_broadcast(df, max_rows=1000, max_bytes=1 << 20))
    assert not hinted(maybe_broadcast(df, max_rows=99, max_bytes=1 << 20))      # too many rows
    assert not hinted(maybe_broadcast(df, max_rows=1000, max_bytes=1000))       # too many bytes


def test_audit_keyset_pages_equal_offset_pages(spark):
    from slicewatch.operators import audit as audit_ops
    rows = [(b, s, None if b < 0 else f"t{s % 3}", o, "agent", "x", "{}")
            for b in (-1, 0, 1) for s in range(4) for o in range(2)]
    rows += [(0, 2, None, 0, "agent", "x", "{}"), (0, 2, "t0", 1, "agent", "x", "{}")]   # null and ids mixed
    a = spark.createDataFrame(rows, "batch_seq long, seq long, transaction_id string, ordinal int, policy string, "
                                    "stage string, detail string")
    key = ("batch_seq", "seq", "transaction_id", "ordinal")
    before = None
    for page in range(5):
        by_offset = audit_ops.audit_view(a, limit=5, offset=page * 5).collect()
        by_key = audit_ops.audit_view(a, limit=5, before=before).collect()
        assert [tuple(r[k] for k in key) for r in by_key] == [tuple(r[k] for k in key) for r in by_offset]
        if by_offset:
            before = tuple(by_offset[-1][k] for k in key)


def test_rerun_opens_only_the_buckets_that_may_hold_its_keys(spark, txn_df, tmp_path):
    from slicewatch.sources import outcome_index, store
    from slicewatch.sources.snapshots import Snapshots
    rows = [(f"t{i}", "upi", "gw_a", dt.datetime(2026, 1, 1 + i % 5, 10), 50.0, "c", "new", 0, "otp_timeout",
             False, 0.5, 0.5) for i in range(200)]
    txns = txn_df(rows).withColumn("event_id", F.lit(None).cast("bigint"))
    root = str(tmp_path / "store")
    store.run_and_store(spark, txns, root, "r1", P)
    folders = Snapshots(spark, root).state().tables[outcome_index.KEYS].folders

    def opened(batch):
        known = store.prior_outcomes(spark, root, "r2", batch, ("baseline", "agent"))
        keys = {f.split("bucket=")[1].split("/")[0] for f in known.inputFiles() if "/outcome_keys/" in f}
        return known, keys
    again, keys = opened(txns.where("transaction_id = 't7'"))
    assert {(r.transaction_id, r.policy) for r in again.collect()} == {("t7", "baseline"), ("t7", "agent")}
    assert 0 < len(keys) <= 2 and len({f.split("/")[-1] for f in folders}) > 20      # two keys, two buckets of 32
    new = txn_df([(f"n{i}", *rows[0][1:]) for i in range(100)]).withColumn("event_id", F.lit(None).cast("bigint"))
    unknown, keys = opened(new)
    assert unknown.count() == 0 and len(keys) <= 4                                 # filters answer nearly all
