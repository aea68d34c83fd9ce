"""Decision validation, routing, idempotent reruns and outcome accounting."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from slicewatch.operators.validate import parse_decisions, route
from slicewatch.plans.run import run_all, run_policy
from slicewatch.sources import store

BASE = {"transaction_id": "t1", "decision": "retry_now", "reasoning": "r", "confidence": 0.9}


def _validate(spark, docs):
    rows = [(i, "t1", "agent", d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "seq long, transaction_id string, policy string, raw string")
    return {r.seq: r for r in parse_decisions(df).collect()}


def test_reference_validation_cases(spark):
    no_reason = {k: v for k, v in BASE.items() if k != "reasoning"}
    no_conf = {k: v for k, v in BASE.items() if k != "confidence"}
    got = _validate(spark, [BASE, no_reason, no_conf, {**BASE, "decision": "retry_later"}])
    assert [got[i].is_valid for i in range(4)] == [True, False, False, False]


def test_lax_coercions(spark):
    ok = [{**BASE, "confidence": "0.8"}, {**BASE, "confidence": True}, {**BASE, "delay_hours": 4.0},
          {**BASE, "delay_hours": "4"}, {**BASE, "delay_hours": -1}, {**BASE, "discount_pct": True},
          {**BASE, "reasoning": ""}, {**BASE, "extra": 1}]
    bad = [{**BASE, "confidence": 1.0001}, {**BASE, "transaction_id": 5}, {**BASE, "delay_hours": 4.5},
           {**BASE, "delay_hours": "4.5"}, {**BASE, "reasoning": None}, "not json", '{"confidence": NaN}']
    got = _validate(spark, ok + bad)
    assert [got[i].is_valid for i in range(len(ok))] == [True] * len(ok)
    assert [got[len(ok) + i].is_valid for i in range(len(bad))] == [False] * len(bad)
    assert got[2].delay_hours == 4 and got[0].confidence == 0.8 and got[1].confidence == 1.0


def test_scorer_failure_becomes_escalate_fallback(spark):
    got = _validate(spark, [None])
    assert got[0].decision == "escalate" and got[0].confidence == 0.0 and got[0].is_valid


def _txn(spark, txn_df, ids=("t1",)):
    return txn_df([(i, "upi", "gw_a", dt.datetime(2026, 1, 1), 500.0, "c1", "new", 0, "otp_timeout", False, 0.9, 0.9)
                   for i in ids]).withColumn("event_id", F.lit(None).cast("bigint"))


def test_routing_order_unknown_invalid_duplicate(spark, txn_df):
    txns = _txn(spark, txn_df)
    rows = [(0, "t1", "agent", json.dumps(BASE)), (1, "t1", "agent", json.dumps(BASE)),
            (2, "zz", "agent", json.dumps(BASE)), (3, "t1", "agent", "{}")]
    d = parse_decisions(spark.createDataFrame(rows, "seq long, transaction_id string, policy string, raw string"))
    st = {r.seq: r.status for r in route(d, txns).collect()}
    assert st == {0: "execute", 1: "skipped_duplicate", 2: "skipped_unknown_transaction",
                  3: "skipped_invalid_decision_schema"}


def test_idempotent_rerun_with_stored_outcomes(spark, txn_df, tmp_path):
    txns = _txn(spark, txn_df)
    root = str(tmp_path / "store")
    first = store.run_and_store(spark, txns, root, "r1", policies=("baseline",))
    assert first["outcomes"].count() == 1
    second = store.run_and_store(spark, txns, root, "r2", policies=("baseline",))
    assert second["outcomes"].count() == 0
    outcomes = store.read_table(spark, root, "outcomes")
    assert outcomes.count() == 1
    audit = store.read_table(spark, root, "audit_log")
    skipped = audit.where((F.col("run_id") == "r2") & (F.col("stage") == "action")).collect()
    assert len(skipped) == 1 and json.loads(skipped[0].detail)["action_type"] == "skipped_duplicate"
    assert audit.where(F.col("run_id") == "r1").count() == 4


def test_outcome_accounting_invariants(spark, txn_df):
    ids = [f"t{i}" for i in range(200)]
    txns = txn_df([(t, "upi", "gw_a", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), 100.0 + i * 1.37, "c",
                    ["new", "repeat", "high_value", "at_risk"][i % 4], i % 4,
                    ["cart_abandonment", "bank_decline", "otp_timeout", "card_expired", "insufficient_funds"][i % 5],
                    i % 3 == 0, (i % 90 + 2) / 100.0, 0.85)
                   for i, t in enumerate(ids)]).withColumn("event_id", F.lit(None).cast("bigint")) \
        .withColumn("best_peer_rate", F.lit(0.95)).withColumn("best_peer", F.lit("gw_b")) \
        .withColumn("event_window_end", F.lit(None).cast("timestamp_ntz"))
    w = run_all(txns).collect()
    assert len(w) == 400
    for r in w:
        assert r.net_paise == r.recovered_paise - r.discount_paise - r.cost_paise
        if not r.success:
            assert r.recovered_paise == 0 and r.discount_paise == 0
        if r.allowed_action == "give_up":
            assert r.cost_paise == 0 and not r.success
        else:
            assert r.cost_paise == 200
        assert 0.0 <= r.probability_used <= 1.0


def test_draw_is_independent_of_partitioning(spark, txn_df):
    ids = [f"t{i}" for i in range(50)]
    txns = _txn(spark, txn_df, ids)
    a = {r.transaction_id: r.u for r in run_all(txns.repartition(1)).collect()}
    b = {r.transaction_id: r.u for r in run_all(txns.repartition(7)).collect()}
    assert a == b


def test_run_policy_external_decisions(spark, txn_df):
    txns = _txn(spark, txn_df)
    d = parse_decisions(spark.createDataFrame([(0, "t1", "agent", json.dumps({**BASE, "decision": "send_discount",
                                                                              "discount_pct": 40}))],
                                              "seq long, transaction_id string, policy string, raw string"))
    r = run_policy(d, txns).collect()[0]
    assert r.status == "execute" and r.final_discount_pct == 15 and r.block_reason.startswith("discount_capped")


def test_scorer_slot_sees_prompts_only_and_request_id_wins(spark, txn_df):
    import pandas as pd

    from slicewatch.operators.policies import scored_policy
    txns = _txn(spark, txn_df, ("t1", "t2", "t3")).withColumn("root_cause_statement", F.lit(None).cast("string"))

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        assert list(batch.columns) == ["transaction_id", "prompt"]          # hidden columns never reach it
        assert not batch["prompt"].str.contains("ground_truth|0.9", regex=True).any()
        raw = [None if t == "t2" else json.dumps({**BASE, "transaction_id": "echoed-wrong-id"})
               for t in batch["transaction_id"]]
        return pd.DataFrame({"raw": raw})

    scored = scored_policy(txns, scorer)
    assert scored.columns == ["seq", "transaction_id", "raw", "policy"]
    r = {x.transaction_id: x for x in run_policy(parse_decisions(scored), txns).collect()}
    assert set(r) == {"t1", "t2", "t3"}                                     # the request's id, not the echo
    assert r["t2"].decision == "escalate" and r["t2"].confidence == 0.0 and r["t2"].status == "execute"
    assert r["t1"].decision == "retry_now" and r["t1"].status == "execute"
