"""Root cause classification over peers in the event window."""

from __future__ import annotations

import datetime as dt

from slicewatch.operators.root_cause import root_cause
from slicewatch.params import Params

T0 = dt.datetime(2026, 1, 1, 10)


def _rows(method, gateway, rates):
    return [(T0 + dt.timedelta(hours=i), method, gateway, r, 200.0, 100) for i, r in enumerate(rates)]


def _event(spark, method="upi", gateway="gw_bad"):
    return spark.createDataFrame(
        [(1, method, gateway, T0, T0 + dt.timedelta(hours=3), 0.95, 0.65, "critical", 5.0, 3)],
        "event_id bigint, payment_method string, bank_gateway string, window_start timestamp_ntz, "
        "window_end timestamp_ntz, baseline_rate double, current_rate double, severity string, z_score double, n_rows bigint")


def _rc(spark, health_df, *slices, p=Params()):
    rows = [r for s in slices for r in _rows(*s)]
    return root_cause(_event(spark), health_df(rows), p).collect()[0]


def test_gateway_specific_isolated(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_good1", [0.96] * 3),
            ("upi", "gw_good2", [0.97] * 3), ("card", "gw_other_method", [0.95] * 3))
    assert r.classification == "gateway_specific_issue" and r.is_isolated
    assert r.best_peer == "gw_good2" and r.best_peer_rate == 0.97
    assert "gw_bad" in r.root_cause_statement and "gw_good1" not in r.root_cause_statement
    assert "65%" in r.root_cause_statement and "95%" in r.root_cause_statement
    assert dict(r.other_gateway_rates) == {"gw_good1": 0.96, "gw_good2": 0.97}


def test_method_wide(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [0.6] * 3),
            ("card", "gw_bad", [0.95] * 3))
    assert r.classification == "payment_method_wide_issue" and not r.is_isolated


def test_gateway_wide(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [0.95] * 3),
            ("card", "gw_bad", [0.5] * 3))
    assert r.classification == "gateway_wide_issue"


def test_both_bad_is_platform_wide(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [0.5] * 3),
            ("card", "gw_bad", [0.5] * 3))
    assert r.classification == "platform_wide_incident"


def test_peers_fine_but_global_low_is_platform_wide(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [0.95] * 3),
            ("card", "gw_y", [0.3] * 3), ("wallet", "gw_z", [0.3] * 3))
    assert r.other_gateways_stable and r.other_methods_stable
    assert r.classification == "platform_wide_incident"
    assert abs(r.global_other_rate - (0.95 * 3 + 0.3 * 6) / 9) < 1e-12


def test_no_peers_at_all_is_isolated(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3))
    assert r.is_isolated and r.classification == "gateway_specific_issue"
    assert r.global_other_rate is None and r.best_peer is None


def test_peer_rounded_before_threshold(spark, health_df):
    # peer mean .89996 rounds to .9000 → stable; the global mean stays unrounded
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [0.89996] * 3))
    assert r.other_gateways_stable and r.classification == "platform_wide_incident"
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [0.89996] * 3),
            ("card", "gw_y", [0.99] * 3))
    assert r.other_gateways_stable and r.classification == "gateway_specific_issue"


def test_peer_with_only_null_rates_is_unstable(spark, health_df):
    r = _rc(spark, health_df, ("upi", "gw_bad", [0.65] * 3), ("upi", "gw_x", [None] * 3),
            ("card", "gw_bad", [0.95] * 3))
    assert not r.other_gateways_stable
    assert r.classification == "payment_method_wide_issue"


def test_rows_outside_window_are_ignored(spark, health_df):
    late = [(T0 + dt.timedelta(hours=3 + i), "upi", "gw_x", 0.1, 200.0, 100) for i in range(5)]
    rows = _rows("upi", "gw_bad", [0.65] * 3) + _rows("upi", "gw_x", [0.95] * 3) + late
    r = root_cause(_event(spark), health_df(rows)).collect()[0]
    assert r.classification == "gateway_specific_issue"


def test_whole_percent_is_half_even(spark):
    from slicewatch.functions.numeric import whole_percent
    df = spark.createDataFrame([(0.945,), (0.955,), (0.9449,), (0.5,)], "r double")
    got = [x.p for x in df.select(whole_percent("r").alias("p")).collect()]
    assert got == [f"{v * 100:.0f}" for v in (0.945, 0.955, 0.9449, 0.5)]
