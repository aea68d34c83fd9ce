"""Baseline, breach and event detection (health series → degradation events)."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from conftest import health_rows
from slicewatch.operators.baseline import with_baseline, with_breach
from slicewatch.operators.events import detect_events
from slicewatch.params import Params


def test_healthy_series_has_no_events(spark, health_df):
    h = health_df(health_rows("upi", "gw_a", hours=72))
    assert detect_events(h).count() == 0


def test_one_drop_is_found_inside_true_window(spark, health_df):
    h = health_df(health_rows("upi", "gw_a", hours=60, drop_start=30, drop_len=5, drop_rate=0.70))
    ev = detect_events(h).collect()
    assert len(ev) >= 1
    t0 = dt.datetime(2026, 1, 1)
    lo, hi = t0 + dt.timedelta(hours=30), t0 + dt.timedelta(hours=35)
    for e in ev:
        assert lo <= e.window_start and e.window_end <= hi
        assert e.baseline_rate - e.current_rate >= 0.15
        assert e.event_id == 1


def test_only_bad_gateway_is_flagged(spark, health_df):
    h = health_df(health_rows("upi", "gw_ok", hours=60, phase=3),
                  health_rows("upi", "gw_bad", hours=60, drop_start=30, drop_len=5))
    ev = detect_events(h).collect()
    assert {e.bank_gateway for e in ev} == {"gw_bad"}


def test_baseline_equals_pandas_shift_rolling(spark, health_df):
    rows = health_rows("m", "g", hours=80, drop_start=50, drop_len=4)
    h = health_df(rows)
    got = with_baseline(h).orderBy("ts").toPandas()
    pdf = pd.DataFrame(rows, columns=["ts", "m", "g", "success_rate", "lat", "vol"])
    shifted = pdf["success_rate"].shift(1)
    mean = shifted.rolling(48, min_periods=6).mean()
    std = shifted.rolling(48, min_periods=6).std()
    assert got["rolling_baseline_success_rate"].isna().sum() == mean.isna().sum() == 6
    diff_m = (got["rolling_baseline_success_rate"] - mean).abs().max()
    diff_s = (got["rolling_baseline_std"] - std).abs().max()
    assert diff_m < 1e-12 and diff_s < 1e-9


def test_min_periods_and_frame_excludes_current_row(spark, health_df):
    h = health_df(health_rows("m", "g", hours=10))
    b = with_baseline(h).orderBy("ts").collect()
    assert all(r.rolling_baseline_success_rate is None for r in b[:6])
    expected = sum(r.success_rate for r in b[:6]) / 6
    assert abs(b[6].rolling_baseline_success_rate - expected) < 1e-12


def test_null_rate_is_never_a_breach(spark, health_df):
    rows = health_rows("m", "g", hours=20)
    rows[15] = rows[15][:3] + (None,) + rows[15][4:]
    f = with_breach(with_baseline(health_df(rows))).where(F.col("success_rate").isNull()).collect()
    assert len(f) == 1 and f[0].breach is False


def test_runs_are_adjacent_rows_not_clock_hours(spark, health_df):
    # drop rows 30..33, but remove the hour at index 32 from the series: still one run of 3 rows
    rows = health_rows("m", "g", hours=50, drop_start=30, drop_len=4)
    del rows[32]
    ev = detect_events(health_df(rows)).collect()
    assert len(ev) == 1 and ev[0].n_rows == 3


def test_strict_gaps_lets_a_missing_cell_end_a_run(spark, health_df):
    rows = health_rows("m", "g", hours=50, drop_start=30, drop_len=6)
    del rows[33]                                   # breaching rows 30-32 and 34-35 around a missing hour
    h = health_df(rows)
    assert [r.n_rows for r in detect_events(h).collect()] == [5]
    strict = detect_events(h, Params(strict_gaps=True)).collect()
    assert [r.n_rows for r in strict] == [3]       # 30-32 is a run of 3; 34-35 is too short


def test_short_run_is_ignored_and_min_run_is_a_parameter(spark, health_df):
    h = health_df(health_rows("m", "g", hours=50, drop_start=30, drop_len=2))
    assert detect_events(h).count() == 0
    assert detect_events(h, Params(min_run_rows=2)).count() == 1


def test_severity_buckets(spark):
    from slicewatch.functions.exprs import severity_expr
    df = spark.createDataFrame([(0.30,), (0.25,), (0.2,), (0.15,), (0.1,), (0.08,), (0.05,)], "d double")
    got = [r.s for r in df.select(severity_expr("d").alias("s")).collect()]
    assert got == ["critical", "critical", "high", "high", "medium", "medium", "low"]


def test_event_ids_are_dense_in_slice_time_order(spark, health_df):
    h = health_df(
        health_rows("b", "g2", hours=80, drop_start=30, drop_len=4),
        health_rows("a", "g1", hours=80, drop_start=60, drop_len=4),
        health_rows("a", "g1", start="2026-01-01 00:00:00", hours=0),
        health_rows("b", "g1", hours=80, drop_start=20, drop_len=3, phase=5),
    )
    ev = detect_events(h).orderBy("event_id").collect()
    keys = [(e.payment_method, e.bank_gateway, e.window_start) for e in ev]
    assert keys == sorted(keys)
    assert [e.event_id for e in ev] == list(range(1, len(ev) + 1))


def _same(a, b) -> bool:
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_time_chunked_plan_equals_slice_windows(spark):
    """The chunked plan (frames spanning many chunks: 8 cells per chunk, 49-row frames) gives
    exactly the slice-window results on table data, baselines and events alike."""
    from slicewatch.plans.diagnose import health_from_tables
    p = Params(grain_hours=6)
    h = health_from_tables(spark, "/root/testdata/sf0.01", p, cut=False).cache()
    for chunk in (48, 24 * 7):
        pc = p.with_(time_chunk_hours=chunk)
        assert _same(with_baseline(h, p), with_baseline(h, pc))
        assert _same(detect_events(h, p), detect_events(h, pc))
    assert _same(detect_events(h, p), detect_events(h, p.with_(time_chunk_hours=24 * 7), cut=True))
    h.unpersist()


def test_time_chunked_plan_with_strict_gaps(spark, health_df):
    rows = health_rows("m", "g", hours=120, drop_start=60, drop_len=7) + health_rows("m", "h", hours=120, phase=2)
    del rows[63]
    del rows[20]
    h = health_df(rows)
    for strict in (False, True):
        p = Params(strict_gaps=strict)
        assert _same(detect_events(h, p), detect_events(h, p.with_(time_chunk_hours=5)))


def test_streaming_detection_equals_batch_in_any_order_and_after_restarts(spark, health_df, tmp_path):
    """Cells come in four parts, up to 30 hours late; the stream is started anew for each part."""
    from slicewatch.streaming.detect_stream import emitted, open_events, refused, run_detect_stream
    a = health_rows("m", "g", hours=120, drop_start=40, drop_len=7)
    del a[43]                                                     # a missing cell inside the drop
    b = health_rows("m", "h", hours=120, drop_start=116, drop_len=4, phase=2)   # a run open at the end
    c = health_rows("n", "g", hours=50, drop_start=28, drop_len=12, phase=4)    # a run across several parts
    rows = a + b + c
    came = [(i * 7 % 30 + (r[0] - rows[0][0]).total_seconds() / 3600, r) for i, r in enumerate(rows)]
    parts = [[r for at, r in reversed(came) if lo <= at < lo + 38] for lo in range(0, 152, 38)]
    assert sum(map(len, parts)) == len(rows)
    for strict, chunk in ((False, None), (True, 9)):
        p = Params(strict_gaps=strict, time_chunk_hours=chunk)
        source, root = str(tmp_path / f"cells-{strict}"), str(tmp_path / f"stream-{strict}")
        for part in parts:
            health_df(part).write.mode("append").parquet(source)
            run_detect_stream(spark, source, root, p, delay_hours=30)
        batch = detect_events(health_df(rows), p).drop("event_id")
        assert refused(spark, root).count() == 0
        closed = emitted(spark, root)
        assert _same(closed.unionByName(open_events(spark, root, p)).select(*batch.columns), batch)
        assert closed.where("bank_gateway = 'h'").count() == 0 and batch.where("bank_gateway = 'h'").count() == 1
        assert sorted(r.n_rows for r in batch.where("payment_method = 'm' and bank_gateway = 'g'").collect()) == (
            [3, 3] if strict else [6])
        # a cell at or before the last processed one, and one without a time, change nothing
        health_df([rows[5], (None, *rows[6][1:])]).write.mode("append").parquet(source)
        run_detect_stream(spark, source, root, p, delay_hours=30)
        assert refused(spark, root).count() == 2
        assert emitted(spark, root).count() == closed.count()
