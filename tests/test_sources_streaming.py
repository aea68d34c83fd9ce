"""Sources and sinks (CSV/parquet reads, run-table storage, JSON export), the order-line source
against brute force, the event list top-k, and late-data handling of the streaming rollup."""

from __future__ import annotations

import datetime as dt
import json
import os

import pandas as pd
from pyspark.sql import functions as F

from conftest import HEALTH_SCHEMA, health_rows
from slicewatch.operators import audit as audit_ops
from slicewatch.operators import views
from slicewatch.operators.linkage import link_single
from slicewatch.params import Params
from slicewatch.plans.diagnose import diagnose
from slicewatch.sources import store
from slicewatch.sources.order_lines import order_line_health_tables
from slicewatch.sources.payments import read_health, read_transactions
from slicewatch.streaming.rollup_stream import open_cells, run_rollup

SF = "/root/testdata/sf0.001"


def _health(spark, hours=72):
    rows = (health_rows("upi", "gw_a", hours=hours, drop_start=40, drop_len=5)
            + health_rows("upi", "gw_b", hours=hours, phase=3)
            + health_rows("card", "gw_a", hours=hours, phase=5))
    return spark.createDataFrame(rows, HEALTH_SCHEMA)


def test_health_csv_and_parquet_reads_agree(spark, tmp_path):
    h = _health(spark)
    (h.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "payment_method", "bank_gateway",
              "success_rate", "avg_latency_ms", "transaction_volume")
     .coalesce(1).write.option("header", True).csv(str(tmp_path / "csv")))
    h.write.parquet(str(tmp_path / "pq"))
    a = read_health(spark, str(tmp_path / "csv"), fmt="csv")
    b = read_health(spark, str(tmp_path / "pq"))
    assert a.schema == b.schema
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_transactions_csv_read_and_single_event_linkage(spark, txn_df, tmp_path):
    t0 = dt.datetime(2026, 1, 1, 10)
    rows = [(f"t{i}", "upi", "gw_a", t0 + dt.timedelta(minutes=30 * i), 10.0 * i, "c", "new", i % 4, "otp_timeout",
             i % 2 == 0, 0.5, 0.5) for i in range(6)]
    t = txn_df(rows)
    (t.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c == "ts" else F.col(c) for c in t.columns])
     .coalesce(1).write.option("header", True).csv(str(tmp_path / "txn")))
    back = read_transactions(spark, str(tmp_path / "txn"))
    assert back.schema == t.schema and back.exceptAll(t).count() == 0
    event = spark.createDataFrame([(7, "upi", "gw_a", t0 + dt.timedelta(minutes=30), t0 + dt.timedelta(minutes=90))],
                                  "event_id long, payment_method string, bank_gateway string, "
                                  "window_start timestamp_ntz, window_end timestamp_ntz")
    got = {r.transaction_id: r.event_id for r in link_single(back, event, Params()).collect()}
    assert got == {"t0": None, "t1": 7, "t2": 7, "t3": None, "t4": None, "t5": None}   # [start, end)


def test_store_round_trip_and_append_only_touches_new_days(spark, txn_df, tmp_path):
    h = _health(spark)
    txns = txn_df([("t1", "upi", "gw_a", dt.datetime(2026, 1, 2, 17, 30), 500.0, "c1", "new", 1, "gateway_timeout",
                    False, 0.4, 0.4)])
    d = diagnose(h, txns, Params(healthy_threshold=0.6), cut=False)
    root = str(tmp_path / "store")
    store.write_diagnosis(d.health, d.events, d.linked, root)
    ev, tx = store.reload_diagnosis(spark, root)
    assert ev.count() == d.events.count() == 1
    assert tx.where("event_id IS NOT NULL").count() == 1        # the transaction sits inside the event

    health_dir = os.path.join(root, "health")
    before = {os.path.join(d, f) for d, _, files in os.walk(health_dir) for f in files if f.endswith(".parquet")}
    new = spark.createDataFrame(health_rows("upi", "gw_a", start="2026-01-10 00:00:00", hours=3), HEALTH_SCHEMA)
    store.append_health(new, root)
    after = {os.path.join(d, f) for d, _, files in os.walk(health_dir) for f in files if f.endswith(".parquet")}
    assert before < after and all("date=2026-01-10" in f for f in after - before)
    used = {f.removeprefix("file://") for f in store.read_table(spark, root, "health").inputFiles()}
    assert used == after                                         # the other days are read from the files they had
    assert store.read_table(spark, root, "health").count() == h.count() + 3


def test_audit_export_is_json_lines_newest_first(spark, tmp_path):
    rows = [(0, 1, "t1", 0, "agent", "decision", json.dumps({"a": 1})),
            (0, 2, "t2", 0, "agent", "decision", json.dumps({"a": 2})),
            (1, 1, "t1", 3, "agent", "outcome", json.dumps({"a": 3}))]
    audit = spark.createDataFrame(rows, "batch_seq long, seq long, transaction_id string, ordinal int, policy string, "
                                        "stage string, detail string")
    out = str(tmp_path / "audit")
    audit_ops.export_audit(audit.repartition(3), out)
    lines = []
    for name in sorted(os.listdir(out)):
        if name.endswith(".json"):
            with open(os.path.join(out, name)) as fh:
                lines += [json.loads(x) for x in fh if x.strip()]
    assert [(x["batch_seq"], x["seq"]) for x in lines] == [(1, 1), (0, 2), (0, 1)]
    assert json.loads(lines[0]["detail"]) == {"a": 3}


def test_event_list_limit_is_a_top_k(spark):
    ev = spark.createDataFrame(
        [(i, "upi", "g", dt.datetime(2026, 1, 1) + dt.timedelta(hours=10 - i)) for i in range(1, 6)],
        "event_id long, payment_method string, bank_gateway string, window_start timestamp_ntz")
    top = views.event_list(ev, limit=2).collect()
    assert [r.event_id for r in top] == [5, 4]
    assert views.event_list(ev, payment_method="card", limit=2).count() == 0


def test_order_line_health_equals_brute_force(spark):
    """Spark (pre-aggregated per order, then joined) against pandas over the joined lines."""
    got = order_line_health_tables(spark, SF, 720).toPandas()
    li = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_returnflag", "l_extendedprice"])
    o = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    c = pd.read_parquet(f"{SF}/customer.parquet", columns=["c_custkey", "c_mktsegment"])
    j = li.merge(o, left_on="l_orderkey", right_on="o_orderkey").merge(c, left_on="o_custkey", right_on="c_custkey")
    epoch = pd.Timestamp("1970-01-01")
    width = pd.Timedelta(hours=720)
    j["ts"] = epoch + ((j["o_orderdate"] - epoch) // width) * width
    j["ok"] = (j["l_returnflag"] != "R").astype(int)
    want = j.groupby(["ts", "o_orderpriority", "c_mktsegment"]).agg(
        n=("ok", "size"), ok=("ok", "sum"), lat=("l_extendedprice", "mean")).reset_index()
    assert len(got) == len(want)
    m = got.merge(want, left_on=["ts", "payment_method", "bank_gateway"],
                  right_on=["ts", "o_orderpriority", "c_mktsegment"])
    assert len(m) == len(want)
    assert (m["transaction_volume"] == m["n"]).all()
    assert ((m["success_rate"] - m["ok"] / m["n"]).abs() < 1e-12).all()
    assert ((m["avg_latency_ms"] - m["lat"]).abs() < 1e-6).all()


def _attempt_rows(start: dt.datetime, minutes: list[int], first_id: int) -> list[tuple]:
    # user 1 → method m1; props k = 2 → gateway g2; every third attempt fails
    return [(first_id + i, start + dt.timedelta(minutes=m), 1, "error" if i % 3 == 0 else "purchase", 100.0 + i,
             json.dumps({"k": 2})) for i, m in enumerate(minutes)]


def test_stream_rollup_emits_closed_cells_once_and_drops_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    t0 = dt.datetime(2026, 3, 1)
    spark.createDataFrame(_attempt_rows(t0, list(range(0, 600, 20)), 0), schema).coalesce(1) \
        .write.mode("append").parquet(src)                           # 00:00-09:40
    run_rollup(spark, src, grain_hours=1, sink=sink)
    first = {r.ts: r.transaction_volume for r in spark.read.parquet(sink).collect()}
    # watermark = 09:40 - 1 h: cells 00:00 … 07:00 are closed and emitted, 08:00 and later stay open
    assert sorted(first) == [t0 + dt.timedelta(hours=h) for h in range(8)]
    assert all(v == 3 for v in first.values())

    # second file: a late attempt in the (emitted) 00:00 cell and new attempts up to 13:00
    late = _attempt_rows(t0, [5], 1000)
    fresh = _attempt_rows(t0, list(range(600, 780, 20)), 2000)
    spark.createDataFrame(late + fresh, schema).coalesce(1).write.mode("append").parquet(src)
    run_rollup(spark, src, grain_hours=1, sink=sink)
    rows = spark.read.parquet(sink).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.ts, []).append(r.transaction_volume)
    assert counts[t0] == [3]                                         # late row dropped, cell not re-emitted
    assert all(len(v) == 1 for v in counts.values())
    assert t0 + dt.timedelta(hours=9) in counts                      # 09:00 closed by the later data
    held = {r.ts: (r.transaction_volume, r.avg_latency_ms is not None) for r in open_cells(spark, sink).collect()}
    assert held == {t0 + dt.timedelta(hours=h): (3, True) for h in (11, 12)}       # watermark 11:40, end of the input 12:40
    assert open_cells(spark, str(tmp_path / "never")).count() == 0


def test_package_reaches_python_workers_outside_the_repo(tmp_path):
    """Workers started from another directory import the package only after ``ship_package``."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path / "ckpt")!r}).getOrCreate())
def probe(batches):
    import pandas as pd
    for b in batches:
        try:
            import slicewatch.streaming.detect_stream  # noqa: F401
            ok = True
        except ImportError:
            ok = False
        yield pd.DataFrame({{"ok": [ok] * len(b)}})
def run():
    return all(r.ok for r in spark.range(4).mapInPandas(probe, "ok boolean").collect())
before = run()
from slicewatch.session import ship_package
ship_package(spark)
print("RESULT", before, run())
"""
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line == ["RESULT False True"], out.stdout[-2000:] + out.stderr[-2000:]


def test_time_math_ignores_the_session_time_zone(spark):
    """Wall-clock (TIMESTAMP_NTZ) values, including one inside a daylight-saving gap, give the same
    epoch, buckets and tumbling cells under any session time zone."""
    from slicewatch.functions.timeutil import bucket_of, epoch_micros, from_epoch_micros
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ'2024-03-10 01:30:00', TIMESTAMP_NTZ'2024-03-10 02:30:00.25', "
                   "TIMESTAMP_NTZ'2024-03-10 03:30:00', TIMESTAMP_NTZ'2024-11-03 01:30:00')) AS ts")
    zoned = F.timestamp_micros(epoch_micros("ts"))
    q = df.select("ts", epoch_micros("ts").alias("us"), bucket_of("ts", 3600).alias("b"),
                  from_epoch_micros(F.unix_micros(F.window(zoned, "6 hours").start)).alias("cell"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = {}
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got[tz] = sorted(tuple(r) for r in q.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got["UTC"] == got["America/New_York"]
    assert [r[1] for r in got["UTC"]][:3] == [1710034200000000, 1710037800250000, 1710041400000000]
    assert [r[3].hour for r in got["UTC"]][:3] == [0, 0, 0]
