"""Shared fixtures: one local SparkSession and small literal health / transaction builders."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# deterministic small noise instead of a random generator (fixed literal offsets)
NOISE = (0.004, -0.003, 0.002, -0.005, 0.001, 0.003, -0.002, 0.0, -0.004, 0.005, -0.001, 0.002)


@pytest.fixture(scope="session")
def spark():
    from slicewatch.session import build_session
    # plan texts are compared: nothing in them may be cut
    s = build_session("local[2]", app="slicewatch-tests", shuffle_partitions=4, extra={"spark.sql.maxMetadataStringLength": "4000"})
    yield s
    s.stop()


def health_rows(method, gateway, start="2026-01-01 00:00:00", hours=72, base_rate=0.95, drop_start=None,
                drop_len=0, drop_rate=0.70, phase=0):
    t0 = dt.datetime.fromisoformat(start)
    rows = []
    for i in range(hours):
        rate = min(1.0, max(0.0, base_rate + NOISE[(i + phase) % len(NOISE)]))
        if drop_start is not None and drop_start <= i < drop_start + drop_len:
            rate = drop_rate
        rows.append((t0 + dt.timedelta(hours=i), method, gateway, round(rate, 4), 200.0 + (i % 5), 50 + (i * 7) % 100))
    return rows


HEALTH_SCHEMA = ("ts timestamp_ntz, payment_method string, bank_gateway string, success_rate double, "
                 "avg_latency_ms double, transaction_volume bigint")


@pytest.fixture
def health_df(spark):
    def make(*row_lists):
        rows = [r for rl in row_lists for r in rl]
        return spark.createDataFrame(rows, HEALTH_SCHEMA)
    return make


TXN_SCHEMA = ("transaction_id string, payment_method string, bank_gateway string, ts timestamp_ntz, amount double, "
              "customer_id string, customer_history string, retry_count_so_far int, failure_type string, "
              "degradation_linked boolean, ground_truth_recovery_probability double, "
              "ground_truth_recovery_probability_after_recovery double")


@pytest.fixture
def txn_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, TXN_SCHEMA)
    return make
