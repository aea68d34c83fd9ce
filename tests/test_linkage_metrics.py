"""Interval linkage against brute force, backtest, metrics invariants and empty-policy handling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from slicewatch.operators.backtest import backtest
from slicewatch.operators.linkage import link
from slicewatch.operators.metrics import policy_comparison, policy_metrics
from slicewatch.params import Params
from slicewatch.plans.run import run_all

EV_SCHEMA = ("event_id bigint, payment_method string, bank_gateway string, window_start timestamp_ntz, "
             "window_end timestamp_ntz")
T0 = dt.datetime(2026, 1, 1)


def h(x):
    return T0 + dt.timedelta(hours=x)


def test_interval_join_boundaries_and_overlap(spark, txn_df):
    ev = spark.createDataFrame([(2, "m", "g", h(1), h(3)), (1, "m", "g", h(2), h(5)), (3, "m", "x", h(0), h(10))], EV_SCHEMA)
    times = {"a": h(0.5), "b": h(1), "c": h(2.5), "d": h(3), "e": h(5), "f": h(4.999)}
    t = txn_df([(k, "m", "g", v, 10.0, "c", "new", 0, "otp_timeout", None, 0.5, 0.5) for k, v in times.items()])
    got = {r.transaction_id: r.event_id for r in link(t, ev, Params(grain_hours=1)).collect()}
    # half-open windows; overlapping events → lowest id wins
    assert got == {"a": None, "b": 2, "c": 1, "d": 1, "e": None, "f": 1}


def test_linkage_equals_brute_force_on_table_data(spark):
    from slicewatch.plans.diagnose import diagnose_tables
    sf = "/root/testdata/sf0.001"
    d = diagnose_tables(spark, sf, Params())
    got = {r.transaction_id: r.event_id for r in d.linked.select("transaction_id", "event_id").collect()}
    ev = d.events.select("event_id", "payment_method", "bank_gateway", "window_start", "window_end").collect()
    for r in d.linked.select("transaction_id", "payment_method", "bank_gateway", "ts").collect():
        hits = [e.event_id for e in ev if e.payment_method == r.payment_method and e.bank_gateway == r.bank_gateway
                and e.window_start <= r.ts < e.window_end]
        assert got[r.transaction_id] == (min(hits) if hits else None)
    assert d.events.count() == 3           # flagship size at sf0.001 / 1 h grain


def test_linkage_with_many_events_without_broadcast(spark, txn_df):
    ev = spark.createDataFrame([(i + 1, "m", "g", h(3 * i), h(3 * i + 2)) for i in range(50)], EV_SCHEMA)
    t = txn_df([(f"t{i}", "m", "g", h(i * 0.7), 1.0, "c", "new", 0, "x", None, 0.5, 0.5) for i in range(200)])
    a = {r.transaction_id: r.event_id for r in link(t, ev, Params(grain_hours=1, broadcast_max_rows=0)).collect()}
    b = {r.transaction_id: r.event_id for r in link(t, ev, Params(grain_hours=24)).collect()}
    assert a == b and sum(v is not None for v in a.values()) > 0


def test_backtest_nearest_start_wins(spark):
    ev = spark.createDataFrame([(1, "m", "g", h(0), h(4)), (2, "m", "g", h(20), h(22)), (3, "m", "g", h(50), h(60))],
                               EV_SCHEMA)
    labels = spark.createDataFrame([("m", "g", h(18), h(30)), ("m", "g", h(100), h(110)), ("m", "g", h(1), h(21))],
                                   "payment_method string, bank_gateway string, label_start timestamp_ntz, label_end timestamp_ntz")
    got = {r.label_start: r.matched_event_id for r in backtest(labels, ev).collect()}
    assert got == {h(18): 2, h(100): None, h(1): 1}


def _outcomes(spark, txn_df, n=120):
    t = txn_df([(f"t{i}", "m", "g", h(i), 50.0 + i, "c", ["new", "repeat", "high_value", "at_risk"][i % 4], i % 4,
                 ["cart_abandonment", "bank_decline", "otp_timeout"][i % 3], i % 2 == 0, 0.5, 0.9) for i in range(n)])
    t = t.withColumn("event_id", F.when(F.col("degradation_linked"), F.lit(1))).withColumn("best_peer_rate", F.lit(0.5)) \
         .withColumn("event_window_end", F.lit(h(500)))
    return run_all(t)


def test_metric_segments_add_up(spark, txn_df):
    m = {(r.policy, r.segment): r for r in policy_metrics(_outcomes(spark, txn_df)).collect()}
    for pol in ("agent", "baseline"):
        o, li, un = m[(pol, "overall")], m[(pol, "degradation_linked")], m[(pol, "non_degradation_linked")]
        for c in ("total_transactions", "successes", "escalation_count"):
            assert getattr(o, c) == getattr(li, c) + getattr(un, c)
        assert abs(o.net_revenue_recovered_rs - li.net_revenue_recovered_rs - un.net_revenue_recovered_rs) < 1e-6
        assert abs(o.net_revenue_recovered_rs - (o.total_revenue_recovered_rs - o.total_cost_rs)) < 1e-6


def test_missing_policy_gives_zero_rows_and_null_deltas(spark, txn_df):
    only_base = _outcomes(spark, txn_df).where(F.col("policy") == "baseline")
    m = policy_metrics(only_base)
    rows = {(r.policy, r.segment): r for r in m.collect()}
    assert rows[("agent", "overall")].total_transactions == 0
    assert rows[("agent", "overall")].recovery_rate_pct == 0.0
    assert rows[("agent", "overall")].cost_to_recover_per_100 == 0.0
    cmp = policy_comparison(m).collect()[0]
    assert cmp.net_revenue_delta_rs is None and cmp.recovery_rate_delta_pct_points is None


def test_repeated_transaction_ids_keep_one_row(spark, txn_df):
    from slicewatch.sources.payments import duplicate_transaction_ids, unique_transactions
    t0 = dt.datetime(2026, 1, 1, 10)
    row = ("t1", "upi", "gw_a", t0, 10.0, "c", "new", 0, "otp_timeout", False, 0.5, 0.5)
    later = ("t1", "upi", "gw_a", t0 + dt.timedelta(minutes=5), 99.0, "c", "new", 1, "otp_timeout", False, 0.5, 0.5)
    other = ("t2", "upi", "gw_a", t0, 20.0, "c", "new", 0, "otp_timeout", False, 0.5, 0.5)
    t = txn_df([later, row, other, row])
    assert {(r.transaction_id, r.n) for r in duplicate_transaction_ids(t).collect()} == {("t1", 3)}
    u = {r.transaction_id: r for r in unique_transactions(t.repartition(3)).collect()}
    assert set(u) == {"t1", "t2"} and u["t1"].amount == 10.0 and u["t1"].ts == t0
    assert unique_transactions(t).columns == t.columns
