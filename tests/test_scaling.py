"""Steps that grow with the transactions: what is read once, and what is not sent whole to every task."""

from __future__ import annotations

import datetime as dt
import re

from slicewatch.operators import views
from slicewatch.operators.metrics import policy_metrics, recovery_chart
from slicewatch.params import Params
from slicewatch.plans import diagnose as plan
from slicewatch.plans.run import run_all
from slicewatch.session import cut_lineage

T0 = dt.datetime(2026, 1, 1)


def _plan(df, mode="simple"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def _txns(txn_df):
    return txn_df([(f"t{i}", "upi", "gw_a", T0 + dt.timedelta(hours=i), 10.0 + i, "c", "new", i % 4, "otp_timeout",
                    True if i % 3 == 0 else (None if i % 3 == 1 else False), 0.5, 0.9) for i in range(12)]).selectExpr(
        "*", "cast(null as bigint) as event_id")


def test_chart_reads_the_run_once_per_table_and_broadcasts_none(spark, txn_df):
    """outcomes, actions and decisions have a row per decision: no broadcast, no second join for the policies."""
    w = cut_lineage(run_all(_txns(txn_df)), "run")
    base = views.metrics_base(views.outcomes_table(w), views.actions_table(w), views.decisions_table(w))
    chart = recovery_chart(policy_metrics(base))
    text = _plan(chart)
    assert "BroadcastHashJoin" not in text and "BroadcastExchange" not in text
    assert text.count("FileScan parquet") == 3
    got = {r["segment"]: r for r in chart.collect()}
    assert set(got) == {"overall", "degradation_linked", "non_degradation_linked"}
    rows = [r for r in w.collect() if r["status"] == "execute"]
    for pol in ("agent", "baseline"):
        net = {True: 0, False: 0}
        for r in rows:
            if r["policy"] == pol:
                net[bool(r["degradation_linked"])] += r["net_paise"]
        assert got["overall"][f"{pol}_net_rs"] == sum(net.values()) / 100
        assert got["degradation_linked"][f"{pol}_net_rs"] == net[True] / 100
        assert got["non_degradation_linked"][f"{pol}_net_rs"] == net[False] / 100


def test_metrics_segments_of_policies_in_the_data(spark):
    """Policies that the caller did not name get all segments; rows without a policy belong to none."""
    rows = [("other", True, True, "retry_now", 500, 0, 200, 300), (None, False, True, "escalate", 100, 0, 200, -100)]
    df = spark.createDataFrame(rows, "policy string, degradation_linked boolean, success boolean, allowed_action string, "
                                     "recovered_paise long, discount_paise long, cost_paise long, net_paise long")
    m = {(r["policy"], r["segment"]): (r["total_transactions"], r["net_revenue_recovered_rs"]) for r in policy_metrics(df).collect()}
    assert len(m) == 9 and {p for p, _ in m} == {"agent", "baseline", "other"}
    assert m["other", "overall"] == m["other", "degradation_linked"] == (1, 3.0)
    assert m["other", "non_degradation_linked"] == m["agent", "overall"] == (0, 0.0)


def test_run_methods_are_small_enough_to_be_compiled(spark, txn_df):
    """HotSpot leaves methods of more than 8,000 bytes to its interpreter."""
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", _plan(run_all(cut_lineage(_txns(txn_df), "t")), "codegen"))]
    assert sizes and max(sizes) < 8000


def test_event_text_is_parsed_once(spark, tmp_path, monkeypatch):
    """one pass over the events parses their text; the rollup, the quarantine and the linkage read typed columns."""
    rows = [(i, T0 + dt.timedelta(minutes=10 * i), i, "error" if i % 3 else "view", 1.0 + i, '{"k": %d}' % i) for i in range(40)]
    rows += [rows[1], (None, T0, 3, "error", 1.0, '{"k": 1}'), (90, T0, 3, "error", 1.0, "{}"), (91, None, 3, "error", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    parsed = []

    def cut(df, name="table"):
        parsed.extend([name] * df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object"))
        return cut_lineage(df, name)

    monkeypatch.setattr(plan, "cut_lineage", cut)
    d = plan.diagnose_tables(spark, str(tmp_path), Params(time_chunk_hours=240))
    assert parsed == ["attempts"]
    assert sorted(int(r["transaction_id"]) for r in d.linked.collect()) == [i for i in range(40) if i % 3]
    assert {(r["transaction_id"], r["reason"], r["n"]) for r in d.refused.collect()} == {("1", "repeated id", 1), (None, "no id", 1)}
    assert d.health.groupBy().sum("transaction_volume").first()[0] == 42
