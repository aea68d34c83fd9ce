"""Versioned store: atomic rebuilds, merged appends, incremental sums, idempotent outcomes, late linkage, raw files."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewatch.functions.intervals import with_pieces
from slicewatch.functions.numeric import round_double
from slicewatch.operators.backtest import backtest, overlapping
from slicewatch.operators.linkage import event_pieces, link, linkage_summary, stretches
from slicewatch.operators.rollup import health_rollup
from slicewatch.params import Params
from slicewatch.plans.run import run_all
from slicewatch.sources import outcome_index, raw, store
from slicewatch.sources.snapshots import Conflict, Snapshots
from slicewatch.streaming.link_stream import link_waiting, read_linked, run_decision_stream, run_link_stream

from conftest import HEALTH_SCHEMA, health_rows

T0 = dt.datetime(2026, 1, 1)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def numbers(spark, n, start=0):
    return spark.createDataFrame([(i, i % 3) for i in range(start, start + n)], "x long, part int")


# --- snapshots ---------------------------------------------------------------------------------------

def test_readers_see_whole_states_and_writers_conflict(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    assert s.read("a") is None
    base = s.state()
    one = s.commit(base, {"a": s.stage("a", numbers(spark, 9), s.version(base), ("part",)), "b": s.stage("b", numbers(spark, 2), s.version(base))})
    held = s.read("a", one)
    s.stage("a", numbers(spark, 5, 100), s.version(one), ("part",))                # staged, never committed
    assert s.read("a").count() == 9 and s.state().number == 1
    two = s.commit(one, {"a": s.stage("a", numbers(spark, 4, 50), s.version(one), ("part",))})
    assert sorted(r[0] for r in rows_of(s.read("a").select("x"))) == [50, 51, 52, 53] and s.read("b").count() == 2
    assert held.count() == 9 and s.read("a", s.state(1)).count() == 9               # the state before still reads
    with pytest.raises(Conflict):
        s.commit(one, {"b": s.stage("b", numbers(spark, 7), s.version(one))})
    assert s.read("b").count() == 2 and s.state() == two
    none = s.commit(two, {"a": s.stage("a", numbers(spark, 0), s.version(two), ("part",))})
    assert s.read("a", none).columns == ["x", "part"] and s.read("a").count() == 0


def test_old_versions_are_collected(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"))
    for i in range(4):
        state = s.state()
        s.commit(state, {"a": s.stage("a", numbers(spark, i + 1), s.version(state), ("part",))})
    s.stage("a", numbers(spark, 3), s.version(s.state()), ("part",))
    assert s.collect(keep=2) == []                                                # all too young
    time.sleep(1.1)
    gone = s.collect(keep=2, older_than=1)
    assert len(gone) == 3 + 3                                       # 1 + 2 folders of the old states, 3 never committed
    assert s.read("a").count() == 4 and s.read("a", s.state(3)).count() == 3
    with pytest.raises(Exception):
        s.state(1)


# --- series ------------------------------------------------------------------------------------------

def test_append_merges_late_and_repeated_cells(spark, tmp_path):
    root = str(tmp_path / "s")
    cells = {(m, T0 + dt.timedelta(hours=h)): (0.5, 1.0, 10) for m in "ab" for h in range(72)}
    frame = lambda c: spark.createDataFrame([(ts, m, "g", *v) for (m, ts), v in c.items()], HEALTH_SCHEMA)
    store.append_health(frame(cells), root)
    files = set(store.read_table(spark, root, "health").inputFiles())
    more = {("a", T0 + dt.timedelta(hours=30)): (0.9, 2.0, 20), ("c", T0 + dt.timedelta(hours=31)): (0.1, 3.0, 9)}
    twice = frame(more).unionByName(frame({k: (0.2, 1.0, 5) for k in more})).unionByName(
        spark.createDataFrame([(None, "a", "g", 0.1, 1.0, 1)], HEALTH_SCHEMA))
    store.append_health(twice, root)
    store.append_health(twice.limit(0), root)
    got = {(r.payment_method, r.ts): (r.success_rate, r.avg_latency_ms, r.transaction_volume) for r in store.read_table(spark, root, "health").collect()}
    assert got == {**cells, **more}
    kept = files & set(store.read_table(spark, root, "health").inputFiles())
    assert all("date=2026-01-02" not in f for f in kept) and len(kept) == len([f for f in files if "date=2026-01-02" not in f])


def attempts(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=rng.randrange(5000)), f"m{rng.randrange(2)}", "g", rng.choice([True, False, None]),
                                   rng.choice([None, rng.random() * 100])) for i in range(n)],
                                 "attempt_id long, ts timestamp_ntz, payment_method string, bank_gateway string, ok boolean, latency_ms double")


def test_sums_of_parts_equal_the_rollup_of_all(spark, tmp_path):
    root, a = str(tmp_path / "s"), attempts(spark, 900)
    assert store.stored_rollup(spark, root) is None
    part = lambda i: a.where(F.pmod("attempt_id", F.lit(4)) == i)
    for i in (0, 1, 1):
        store.add_attempts(part(i), root, f"p{i}", 1)
    store.add_attempts(part(3), root, "p2", 1)                   # a first attempt of p2 with other rows
    store.add_attempts(part(2), root, "p2", 1)
    store.compact_rollup(spark, root)
    files = store.read_table(spark, root, "cell_sums").inputFiles()
    assert len(files) == len({f.split("date=")[1][:10] for f in files})          # one per day
    with pytest.raises(ValueError):
        store.add_attempts(part(1), root, "p1", 1)
    store.add_attempts(part(3), root, "p3", 1)
    assert set(files) < set(store.read_table(spark, root, "cell_sums").inputFiles())     # nothing old was rewritten
    assert sorted(rows_of(store.stored_rollup(spark, root)), key=str) == sorted(rows_of(health_rollup(a, 1)), key=str)


# --- outcomes ----------------------------------------------------------------------------------------

def some_txns(txn_df, ids, day=1):
    return txn_df([(t, "upi", "gw_a", dt.datetime(2026, 1, day, 10), 50.0, "c", "new", 0, "otp_timeout", False, 0.5, 0.5) for t in ids]
                  ).withColumn("event_id", F.lit(None).cast("bigint"))


def test_a_redelivered_transaction_executes_once_whatever_its_day(spark, txn_df, tmp_path):
    root = str(tmp_path / "s")
    store.run_and_store(spark, some_txns(txn_df, ["a", "b", None]), root, "r1")
    store.run_and_store(spark, some_txns(txn_df, ["a", "c", None], day=9), root, "r2")
    counts = Counter((r.transaction_id, r.policy) for r in store.read_table(spark, root, "outcomes").collect())
    assert counts == {(t, p): 1 for t in "abc" for p in ("baseline", "agent")}
    outcome_index.compact(Snapshots(spark, root))
    again = store.run_and_store(spark, some_txns(txn_df, ["b", "c"], day=20), root, "r3")
    assert {r.status for r in again["wide"].collect()} == {"skipped_duplicate"}


def test_a_run_written_again_replaces_its_first_attempt(spark, txn_df, tmp_path):
    root = str(tmp_path / "s")
    store.run_and_store(spark, some_txns(txn_df, ["a", "b"]), root, "r=1/x")
    store.run_and_store(spark, some_txns(txn_df, ["b", "c"]), root, "r=1/x", policies=("agent",))
    got = {(r.transaction_id, r.policy, r.run_id) for r in store.read_table(spark, root, "outcomes").collect()}
    assert got == {("b", "agent", "r=1/x"), ("c", "agent", "r=1/x")}              # nothing of "a" or of baseline is left
    store.run_and_store(spark, some_txns(txn_df, ["a", "b"]), root, "r2")
    got = Counter((r.transaction_id, r.policy) for r in store.read_table(spark, root, "outcomes").collect())
    assert got == {("a", "agent"): 1, ("a", "baseline"): 1, ("b", "agent"): 1, ("b", "baseline"): 1, ("c", "agent"): 1}


def test_full_filters_cost_buckets_and_no_answers(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "i"))
    pairs = spark.range(3000).select(F.col("id").cast("string").alias("transaction_id"), F.lit("agent").alias("policy"))
    tiny = {"index": {"buckets": 4, "words": 2}}
    s.commit(s.state(), {}, tiny)
    state = s.state()
    tables, notes = outcome_index.stage(s, state, s.version(state), pairs.where("transaction_id % 2 = 0"), "r1")
    s.commit(state, tables, notes)
    for compacted in (False, True):
        got = sorted(int(r[0]) for r in rows_of(outcome_index.known(s, pairs)))
        assert got == list(range(0, 3000, 2))
        assert rows_of(outcome_index.known(s, pairs, "r1")) == ([] if not compacted else [])
        outcome_index.compact(s)
    assert s.state().notes["index"]["words"] >= 64


def event_row(i, t, ok=False):
    return (i, t, 1, "purchase" if ok else "error", 100.0 + i, json.dumps({"k": 2}))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
WINDOWS = ("event_id long, payment_method string, bank_gateway string, window_start timestamp_ntz, window_end timestamp_ntz, "
           "root_cause_statement string, classification string, best_peer string, best_peer_rate double")


def test_late_events_link_waiting_transactions_once(spark, tmp_path):
    src, table, sink = (str(tmp_path / x) for x in ("src", "events", "sink"))
    windows = [(i, "m1", "g2", T0 + dt.timedelta(hours=7 * i), T0 + dt.timedelta(hours=7 * i + 3), f"s{i}", "c", None, None) for i in range(1, 9)]
    known = lambda n: spark.createDataFrame(windows[:n], WINDOWS).write.mode("overwrite").parquet(table)
    spark.createDataFrame([event_row(i, T0 + dt.timedelta(hours=i)) for i in range(40)], EVENTS).coalesce(1).write.parquet(src)
    known(2)
    run_link_stream(spark, src, table, Params(), sink)
    assert read_linked(spark, sink).where("degradation_linked").count() == 6
    waiting = lambda: set(Snapshots(spark, sink).read("waiting").inputFiles())
    before = waiting()
    known(4)
    link_waiting(spark, table, sink, Params())
    assert {f for f in before - waiting()} == {f for f in before if "date=2026-01-01" in f or "date=2026-01-02" in f} - waiting()
    assert read_linked(spark, sink).where("degradation_linked").count() == 12
    spark.createDataFrame([event_row(100 + i, T0 + dt.timedelta(hours=i)) for i in range(60)], EVENTS).coalesce(1).write.mode("append").parquet(src)
    known(8)
    run_link_stream(spark, src, table, Params(), sink)
    state = Snapshots(spark, sink).state()
    link_waiting(spark, table, sink, Params())                     # nothing new: nothing changes
    assert Snapshots(spark, sink).state().tables == state.tables
    got = {r.transaction_id: (r.event_id, r.root_cause_statement) for r in read_linked(spark, sink).collect()}
    want = {}
    for i, h in [(i, i) for i in range(40)] + [(100 + i, i) for i in range(60)]:
        e = next((e for e in range(1, 9) if 7 * e <= h < 7 * e + 3), None)
        want[str(i)] = (e, e and f"s{e}")
    assert got == want


def test_stream_executes_a_redelivered_transaction_once(spark, tmp_path):
    src, table, root = (str(tmp_path / x) for x in ("src", "events", "store"))
    spark.createDataFrame([], WINDOWS).write.parquet(table)
    for day in (0, 5):
        spark.createDataFrame([event_row(i, T0 + dt.timedelta(days=day, hours=i)) for i in range(6)], EVENTS).coalesce(1).write.mode("append").parquet(src)
        run_decision_stream(spark, src, table, root, Params())
    got = Counter((r.transaction_id, r.policy) for r in store.read_table(spark, root, "outcomes").collect())
    assert len(got) == 12 and set(got.values()) == {1}


def test_detection_writes_only_the_buckets_it_touches(spark, tmp_path):
    from slicewatch.operators.events import detect_events
    from slicewatch.streaming.detect_stream import _tables, emitted, open_events, run_detect_stream
    p, src, root = Params(), str(tmp_path / "cells"), str(tmp_path / "stream")
    slices = [(f"m{i}", "g") for i in range(12)]
    first = [r for i, (m, g) in enumerate(slices) for r in health_rows(m, g, hours=60, drop_start=40 if i % 2 else None, drop_len=6)]
    spark.createDataFrame(first, HEALTH_SCHEMA).coalesce(1).write.parquet(src)
    run_detect_stream(spark, src, root, p, delay_hours=0)
    before = set(_tables(spark, root).state().tables["cells"].folders)
    more = health_rows("m1", "g", start="2026-01-03 12:00:00", hours=30, drop_start=2, drop_len=9)
    spark.createDataFrame(more, HEALTH_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run_detect_stream(spark, src, root, p, delay_hours=0)
    after = set(_tables(spark, root).state().tables["cells"].folders)
    assert len(before) > 4 and len(after - before) == len(before - after) == 1      # one slice, one bucket
    whole = detect_events(spark.createDataFrame(first + more, HEALTH_SCHEMA), p).drop("event_id")
    got = emitted(spark, root).unionByName(open_events(spark, root, p)).select(*whole.columns)
    assert sorted(rows_of(got), key=str) == sorted(rows_of(whole), key=str)


def test_unlinked_transactions_are_refused(spark, txn_df):
    with pytest.raises(ValueError, match="not linked"):
        run_all(txn_df([("a", "upi", "gw_a", T0, 1.0, "c", "new", 0, "otp_timeout", True, 0.5, 0.5)]))


# --- intervals ---------------------------------------------------------------------------------------

def test_pieces_cover_their_interval_exactly(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lo = rng.randrange(-3000, 3000) if i % 2 else rng.randrange(1 << 40)
        rows.append((i, lo, lo + rng.choice([0, 1, 2, 15, 16, 17, 300, 5000, -3])))
    df = spark.createDataFrame(rows + [(900, None, 5)], "i long, lo long, hi long")
    for bits, levels in ((4, 13), (1, 20), (1, 3)):
        got = defaultdict(list)
        for r in with_pieces(df, "lo", "hi", bits, levels).collect():
            got[r.i] += range(r.block << (bits * r.level), (r.block + 1) << (bits * r.level))
        assert all(sorted(got[i]) == list(range(lo, hi)) for i, lo, hi in rows) and 900 not in got


def windows(spark, n, seed, longest_hours=9000):
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(1, n * 3), n):
        start = T0 + dt.timedelta(minutes=rng.randrange(400_000), microseconds=rng.randrange(3))
        rows.append((i, f"m{rng.randrange(2)}", "g", start, start + dt.timedelta(minutes=rng.choice([-5, 0, 1, 60, rng.randrange(1, longest_hours * 60)]))))
    return rows, spark.createDataFrame(rows, "event_id long, payment_method string, bank_gateway string, window_start timestamp_ntz, window_end timestamp_ntz")


@pytest.mark.parametrize("bounded", [Params(), Params(broadcast_max_rows=1), Params(bucket_hours=24 * 30)])
def test_long_overlapping_windows_link_to_the_lowest_id(spark, bounded):
    rows, ev = windows(spark, 300, 3)
    rng = random.Random(4)
    txns = [(str(i), f"m{rng.randrange(3)}", "g", T0 + dt.timedelta(minutes=rng.randrange(500_000))) for i in range(800)]
    txns += [(f"s{e[0]}", e[1], e[2], e[3]) for e in rows] + [(f"e{e[0]}", e[1], e[2], e[4]) for e in rows] + [("none", "m0", "g", None)]
    t = spark.createDataFrame(txns, "transaction_id string, payment_method string, bank_gateway string, ts timestamp_ntz")
    got = {r.transaction_id: r.event_id for r in link(t, ev, bounded).collect()}
    want = {k: min((e[0] for e in rows if e[1] == m and ts is not None and e[3] <= ts < e[4]), default=None) for k, m, g, ts in txns}
    assert got == want and sum(v is not None for v in want.values()) > 500


def test_pieces_grow_with_the_logarithm_of_a_window(spark):
    ev = spark.createDataFrame([(1, "m", "g", T0, T0 + dt.timedelta(days=3650))],
                               "event_id long, payment_method string, bank_gateway string, window_start timestamp_ntz, window_end timestamp_ntz")
    assert event_pieces(ev, 3600).count() < 100                     # 87,600 hours
    _, many = windows(spark, 400, 7)
    s = stretches(many)
    assert s.count() <= 800 and "collect_list" not in s._jdf.queryExecution().toString()


def test_seed_label_survives_linkage(spark, txn_df):
    t = txn_df([("a", "upi", "gw_a", T0, 1.0, "c", "new", 0, "otp_timeout", True, 0.5, 0.5), ("b", "upi", "gw_a", T0 + dt.timedelta(days=1), 1.0, "c", "new", 0, "otp_timeout", True, 0.5, 0.5)])
    ev = spark.createDataFrame([(1, "upi", "gw_a", T0, T0 + dt.timedelta(hours=1))],
                               "event_id long, payment_method string, bank_gateway string, window_start timestamp_ntz, window_end timestamp_ntz")
    linked = link(link(t, ev), ev)
    assert rows_of(linkage_summary(linked, ev)) == [(1, 2, 1, 1)]
    bare = link(t.drop("degradation_linked"), ev)
    assert linkage_summary(bare, ev).first()["label_agreement"] is None


def test_backtest_pairs_equal_brute_force(spark):
    rows, ev = windows(spark, 120, 11)
    lab = [(m, "g", T0 + dt.timedelta(days=d), T0 + dt.timedelta(days=d + n)) for m in ("m0", "m1", "m9") for d, n in ((0, 300), (40, 1), (100, 0), (200, 90))]
    labels = spark.createDataFrame(lab, "payment_method string, bank_gateway string, label_start timestamp_ntz, label_end timestamp_ntz")
    real = [(l, e) for l in lab for e in rows if l[0] == e[1] and l[2] < l[3] and e[3] < e[4] and e[3] < l[3] and e[4] > l[2]]
    got = Counter((r.payment_method, r.label_start, r.event_id) for r in overlapping(labels, ev).collect())
    assert got == Counter((l[0], l[2], e[0]) for l, e in real)
    best = {(r.payment_method, r.label_start): r.matched_event_id for r in backtest(labels, ev).collect()}
    for l in lab:
        near = sorted((abs(e[3] - l[2]), e[0]) for x, e in real if x == l)
        assert best[l[0], l[2]] == (near[0][1] if near else None)


# --- numbers and raw files ---------------------------------------------------------------------------

def test_rounding_judges_the_exact_binary_value(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.125, 0.375, 2.5, 0.5, 1.5, -2.675, -0.125, 0.0, 1e300, 2.0 ** 52 + 1, 4503599627370495.5, 1e-70, 5e-324, 9.995, 1024.0]
    xs += [rng.choice([rng.uniform(-1, 1), round(rng.uniform(0, 1000), 3), rng.randrange(-10**7, 10**7) / 2 ** rng.randrange(1, 12),
                       rng.uniform(-1, 1) * 10.0 ** rng.randrange(-19, 17)]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 2, 4, 9):
        assert all(y == round(x, digits) for x, y in rows_of(df.select("x", round_double("x", digits))))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "x double")
    assert [str(r[0]) for r in rows_of(odd.select(round_double("x", 2)))] == ["None", "nan", "-inf"]


def test_raw_files_round_trip_byte_for_byte(spark, tmp_path):
    text = (b'id,amount,note\r\n1,2.5,"a, ""b"""\n2,x,plain\n3,4,too,many\n4,5\n5,6,"open\nquote"\n\n6,NaN,\xff\xfe\n' + b"".join(b"%d,1,z\n" % i for i in range(7, 4000)))
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.csv").write_bytes(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = raw.read_raw(spark, str(src))
        raw.write_back(lines, str(out))
        schema = T.StructType.fromDDL("id long, amount double, note string")
        parsed = raw.parse_raw(lines, schema)
        bad = Counter(p for r in parsed.collect() for p in r.problems)
        good = raw.typed(parsed, schema).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = b"".join((out / f).read_bytes() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert back == text
    assert bad == {"ragged": 5, "amount": 1}                       # too many, too few, both halves of the open quote, empty
    assert good == text.count(b"\n") - 1 - 6


def test_observed_recoveries_equal_brute_force(spark):
    from slicewatch.operators.outcomes import observed_recoveries
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 2]), T0 + dt.timedelta(minutes=rng.randrange(8000)), rng.random() < 0.2) for i in range(400)]
    rows += [(900, 5, T0, False), (901, 5, T0 + dt.timedelta(hours=24), True), (902, 5, T0, True), (903, 6, T0, False)]
    df = spark.createDataFrame(rows, "attempt_id long, user_id long, ts timestamp_ntz, ok boolean")
    got = {r.transaction_id: r.observed_success for r in observed_recoveries(df).collect()}
    want = {str(i): any(o and v == u and t < s <= t + dt.timedelta(hours=24) for _, v, s, o in rows) for i, u, t, ok in rows if not ok}
    assert got == want and want["900"] and not want["903"]
