"""Ordinary dirt: repeats, null ids, NaN, reordered CSV columns, failing scorers, a third policy."""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewatch.operators import views
from slicewatch.operators.baseline import with_baseline
from slicewatch.operators.metrics import policy_metrics
from slicewatch.operators.policies import scored_policy
from slicewatch.operators.validate import parse_decisions, route
from slicewatch.params import Params
from slicewatch.plans.run import run_all
from slicewatch.sources import payments, store
from conftest import HEALTH_SCHEMA, health_rows

T0 = dt.datetime(2026, 1, 1)


def txn(i, minute=0, **kw):
    row = dict(transaction_id=i, payment_method="upi", bank_gateway="gw_a", ts=T0 + dt.timedelta(minutes=minute), amount=500.0,
               customer_id="c", customer_history="new", retry_count_so_far=0, failure_type="otp_timeout", degradation_linked=False,
               p=0.9, q=0.9) | kw
    return tuple(row.values())


def linked(df):
    return df.select("*", F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("root_cause_statement"))


def raw(spark, rows):
    return parse_decisions(spark.createDataFrame(rows, "seq long, transaction_id string, policy string, raw string"))


GOOD = '{"transaction_id": "t", "decision": "retry_now", "reasoning": "r", "confidence": 0.9}'


def test_each_key_executes_once_and_no_row_is_lost(spark, txn_df):
    rows = [(5, "a", "agent", GOOD)] * 3 + [(None, "a", "agent", GOOD), (None, "b", "agent", GOOD), (None, "b", "agent", GOOD),
            (1, None, "agent", GOOD), (1, "a", "other", GOOD), (1, "zz", "agent", GOOD), (0, "a", "agent", "not json"), (1, "c", None, GOOD)]
    got = route(raw(spark, rows), txn_df([txn("a"), txn("b"), txn("c")])).collect()
    assert len(got) == len(rows)
    executed = sorted((r["transaction_id"], r["policy"] or "") for r in got if r["status"] == "execute")
    assert executed == [("a", "agent"), ("a", "other"), ("b", "agent"), ("c", "")]
    assert [r["seq"] for r in got if r["status"] == "execute" and (r["transaction_id"], r["policy"]) == ("a", "agent")] == [5]
    assert sum(r["status"] == "skipped_duplicate" for r in got) == 4
    assert {r["status"] for r in got if r["transaction_id"] in (None, "zz")} == {"skipped_unknown_transaction"}


def test_repeats_inside_a_batch_execute_once(spark, txn_df):
    df = linked(txn_df([txn("a"), txn("a"), txn("a", 3), txn("b")]))
    got = run_all(df).groupBy("policy", "transaction_id", "status").count().collect()
    assert {(r[0], r[1], r[2]): r[3] for r in got} == {
        (p, t, s): n for p in ("agent", "baseline") for t, s, n in (("a", "execute", 1), ("a", "skipped_duplicate", 2), ("b", "execute", 1))}


def test_huge_numbers_are_invalid_not_fatal(spark):
    big = GOOD.replace("0.9}", '0.9, "delay_hours": 1e12, "discount_pct": 1e300}')
    row = raw(spark, [(1, "a", "agent", big)]).first()
    assert not row["is_valid"] and "delay_hours is out of range" in row["invalid_reason"] and row["delay_hours"] is None


def test_nan_is_a_missing_value(spark):
    rows = [list(r) for r in health_rows("upi", "gw", hours=30)]
    rows[4][3] = float("nan")
    df = spark.createDataFrame([tuple(r) for r in rows], HEALTH_SCHEMA)
    s = pd.Series([r[3] for r in rows])
    want_mean, want_std = s.shift(1).rolling(48, min_periods=6).mean(), s.shift(1).rolling(48, min_periods=6).std()
    for p in (Params(), Params(time_chunk_hours=8)):
        got = with_baseline(df, p).orderBy("ts").collect()
        for i, r in enumerate(got):
            if math.isnan(want_mean[i]):
                assert r["rolling_baseline_success_rate"] is None
            else:
                assert r["rolling_baseline_success_rate"] == pytest.approx(want_mean[i], abs=1e-9)
                assert r["rolling_baseline_std"] == pytest.approx(want_std[i], abs=1e-6)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    names = ["customer_id", "transaction_id", "payment_method", "bank_gateway", "timestamp", "amount", "customer_history",
             "retry_count_so_far", "failure_type", "degradation_linked", "ground_truth_recoverable", "ground_truth_recovery_probability",
             "ground_truth_recovery_probability_after_recovery"]
    path = tmp_path / "t.csv"
    path.write_text(",".join(names) + "\nc1,t1,upi,gw,2026-01-01 10:00:00,12.5,new,x,otp_timeout,True,False,0.11,0.82\n")
    row = payments.read_transactions(spark, str(path)).first()
    assert (row["transaction_id"], row["retry_count_so_far"], row["degradation_linked"], row["ground_truth_recoverable"]) == ("t1", None, True, False)
    assert (row["ground_truth_recovery_probability"], row["ground_truth_recovery_probability_after_recovery"]) == (0.11, 0.82)
    path.write_text("transaction_id,amount\nt1,2\n")
    with pytest.raises(ValueError, match="no column payment_method"):
        payments.read_transactions(spark, str(path))
    health = tmp_path / "h.csv"
    health.write_text("bank_gateway,payment_method,timestamp,transaction_volume,avg_latency_ms,success_rate\ng,m,2026-01-01 00:00:00,5,NaN,nan\n")
    row = payments.read_health(spark, str(health), "csv").first()
    assert (row["success_rate"], row["avg_latency_ms"], row["transaction_volume"]) == (None, None, 5)


def test_refused_transactions_are_reported(spark, txn_df):
    df = txn_df([txn("a", 5), txn("a", 1), txn("b"), txn(None)])
    kept = {(r["transaction_id"], r["ts"].minute) for r in payments.unique_transactions(df).collect()}
    assert kept == {("a", 1), ("b", 0)}
    assert sorted(map(str, (tuple(r) for r in payments.refused_transactions(df).collect()))) == sorted(
        map(str, [("a", "repeated id", 1), (None, "no id", 1)]))


def test_scorer_answers_are_matched_by_id(spark, txn_df):
    df = linked(txn_df([txn(f"t{i}", i) for i in range(6)]))

    def scorer(batch):
        if (batch["transaction_id"] == "t3").any():
            raise RuntimeError("no answer")
        out = pd.DataFrame({"transaction_id": batch["transaction_id"], "raw": "answer " + batch["transaction_id"]})
        out = out[out["transaction_id"] != "t4"].iloc[::-1]
        return pd.concat([out, out.assign(raw="second")])
    got = {r["transaction_id"]: r["raw"] for r in scored_policy(df, scorer).collect()}
    assert got == {f"t{i}": None if i in (3, 4) else f"answer t{i}" for i in range(6)}


def test_any_number_of_policies(spark):
    rows = [(p, True, True, 100, 90, 0, 10, "retry_now") for p in ("agent", "third")]
    df = spark.createDataFrame(rows, "policy string, degradation_linked boolean, success boolean, recovered_paise long, net_paise long, "
                                     "discount_paise long, cost_paise long, allowed_action string")
    got = {(r["policy"], r["segment"]): r["total_transactions"] for r in policy_metrics(df).collect()}
    assert got[("third", "overall")] == got[("agent", "overall")] == 1 and got[("baseline", "overall")] == 0 and len(got) == 9


def test_series_pages_by_key(spark, health_df):
    df = health_df(health_rows("upi", "a", hours=7), health_rows("upi", "b", hours=7))
    whole = [tuple(r[:3]) for r in views.timeseries_page(df).collect()]
    assert len(whole) == 14
    pages, after = [], None
    while part := [tuple(r[:3]) for r in views.timeseries_page(df, limit=4, after=after).collect()]:
        pages += part
        after = part[-1]
    assert pages == whole


def test_rebuild_leaves_nothing_behind(spark, tmp_path, txn_df, health_df):
    from slicewatch.plans.diagnose import diagnose
    from slicewatch.plans.run import policy_decisions
    p = Params(healthy_threshold=0.6)
    txns = txn_df([txn("a", 31 * 60), txn("b", 2)]).drop("degradation_linked")
    make = lambda start: diagnose(health_df(health_rows("upi", "gw_a", start, hours=60, drop_start=30, drop_len=5),
                                            health_rows("upi", "gw_b", start, hours=60, phase=3)), txns, p)
    root = str(tmp_path / "store")
    old, new = make("2025-06-01 00:00:00"), make("2026-01-01 00:00:00")
    for d in (old, new):
        store.write_diagnosis(d.health, d.events, d.linked, root)
    assert store.read_table(spark, root, "health").count() == new.health.count()
    events, again = store.reload_diagnosis(spark, root, p)
    assert {"other_gateway_rates", "other_method_rates"} <= set(events.columns)
    live, reloaded = (sorted(map(str, policy_decisions("agent", x, p).drop("seq").collect())) for x in (new.linked, again))
    assert live == reloaded and any("reroute_gateway" in r for r in live)
