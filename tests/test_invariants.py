"""Whole-pipeline invariants on the driver's sf0.001 tables: audit fan-out count, disjoint event
windows per slice, and results that do not depend on the partition count."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slicewatch.operators import audit as audit_ops
from slicewatch.params import Params
from slicewatch.plans.diagnose import diagnose, health_from_tables
from slicewatch.plans.run import run_all
from slicewatch.sources.payments import transactions

SF = "/root/testdata/sf0.001"


def _same(a, b) -> bool:
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_audit_rows_are_four_per_executed_plus_escalations_skips_and_events(spark):
    p = Params(healthy_threshold=0.6)
    d = diagnose(health_from_tables(spark, SF, p, cut=False), transactions(spark, SF), p, cut=False)
    w = run_all(d.linked, p).cache()
    counts = w.agg(F.count_if(F.col("status") == "execute").alias("ex"),
                   F.count_if((F.col("status") == "execute") & (F.col("allowed_action") == "escalate")).alias("esc"),
                   F.count_if(F.col("status") != "execute").alias("skip")).first()
    n_events = d.events.count()
    audit = audit_ops.audit_rows(w).unionByName(audit_ops.event_audit_rows(d.events))
    assert audit.count() == 4 * counts.ex + counts.esc + counts.skip + n_events
    assert n_events > 0 and counts.ex > 0
    w.unpersist()


def test_event_windows_of_a_slice_are_disjoint(spark):
    p = Params()
    d = diagnose(health_from_tables(spark, SF, p, cut=False), transactions(spark, SF), p, cut=False)
    w = Window.partitionBy("payment_method", "bank_gateway").orderBy("window_start")
    overlaps = d.events.withColumn("prev_end", F.lag("window_end").over(w)).where(
        F.col("prev_end") > F.col("window_start"))
    assert overlaps.count() == 0


def test_diagnosis_and_runs_do_not_depend_on_partitioning(spark):
    p = Params(healthy_threshold=0.6)
    h = health_from_tables(spark, SF, p, cut=False)
    t = transactions(spark, SF)
    a = diagnose(h.repartition(1), t.repartition(1), p, cut=False)
    b = diagnose(h.repartition(7), t.repartition(5), p, cut=False)
    drop_maps = ("other_gateway_rates", "other_method_rates")        # maps are compared through their columns
    assert _same(a.events.drop(*drop_maps), b.events.drop(*drop_maps))
    assert _same(a.linked, b.linked)
    assert _same(run_all(a.linked, p), run_all(b.linked, p))


def test_lineage_tables_are_released_per_application(spark):
    import os

    from slicewatch.session import _tables_dir, cut_lineage, release_tables
    t = cut_lineage(spark.range(10), "probe")
    assert t.count() == 10
    folder = _tables_dir(spark)
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    assert os.path.isdir(local) and any(n.startswith("probe-") for n in os.listdir(local))
    assert release_tables(spark)
    assert not os.path.exists(local)
