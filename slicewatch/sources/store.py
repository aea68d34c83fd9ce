"""The tables of a diagnosis and of its runs on storage (parquet).

All tables of a ``root`` lie behind one manifest (``snapshots``): a diagnosis replaces ``health``,
``degradation_events``, ``transactions`` and ``refused_transactions`` together, a run adds its rows of
``decisions``, ``actions_taken``, ``outcomes`` and ``audit_log`` and its keys (``outcome_index``) together. Readers see the
state before or the state after, never a mixture. A run that is written again replaces its first attempt
whole. (transaction, policy) pairs that any run stored are skipped, on whatever day they come again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.operators import audit as audit_ops
from slicewatch.operators import views
from slicewatch.operators.linkage import link
from slicewatch.operators.rollup import cell_sums, health_of, merge_sums
from slicewatch.params import Params
from slicewatch.plans.diagnose import RC_CARRY
from slicewatch.plans.run import run_all
from slicewatch.session import cut_lineage
from slicewatch.sources import outcome_index
from slicewatch.sources.payments import REFUSED
from slicewatch.sources.snapshots import Snapshots, State, Table

RUN_TABLES = ("decisions", "actions_taken", "outcomes", "audit_log")
CELL = ["payment_method", "bank_gateway", "ts"]


def write_diagnosis(health: DataFrame, events: DataFrame, linked: DataFrame, root: str, refused: DataFrame | None = None) -> State:
    """A5-A7 + A9: replace the diagnosis, all tables at once (health partitioned by day). ``refused`` (B13) is
    what linkage left out; without it the table is empty."""
    spark = health.sparkSession
    store = Snapshots(spark, root)
    state = store.state()
    version = store.version(state)
    txn_cols = views.transactions_table(linked).columns
    if refused is None:
        refused = spark.createDataFrame([], REFUSED)
    return store.commit(state, {
        "health": store.stage("health", health.withColumn("date", F.to_date("ts")), version, ("date",)),
        "degradation_events": store.stage("degradation_events", events, version),
        "transactions": store.stage("transactions", linked.select(*txn_cols, "event_id"), version),
        "refused_transactions": store.stage("refused_transactions", refused, version),
    })


def append_health(new_rows: DataFrame, root: str) -> State:
    """A4: merge new cells into the stored series, last write wins per (slice, ts). Only the days that the new
    cells touch are read and written anew; all other files stay as they are. Of several new rows of one
    cell, the one with the largest volume (then rate, then latency) stands; cells without a time are refused.

    The days of a batch reach the driver, one value each."""
    spark = new_rows.sparkSession
    store = Snapshots(spark, root)
    state = store.state()
    rest = ["transaction_volume", "success_rate", "avg_latency_ms"]
    fresh = cut_lineage(new_rows.where(F.col("ts").isNotNull()).select(*CELL, *rest), "new-cells")
    days = {f"date={r[0]}" for r in fresh.select(F.to_date("ts")).distinct().collect()}
    rows = fresh.withColumn("_late", F.lit(1))
    touched = lambda folder: folder.split("/")[-1] in days
    stored = store.read("health", state, touched)
    if stored is not None:
        rows = rows.unionByName(stored.select(*CELL, *rest).withColumn("_late", F.lit(0)))
    last = F.max(F.struct("_late", *rest)).alias("_r")
    merged = rows.groupBy(*CELL).agg(last).select(
        "ts", "payment_method", "bank_gateway", *[F.col("_r")[c].alias(c) for c in ("success_rate", "avg_latency_ms", "transaction_volume")])
    merged = merged.withColumn("date", F.to_date("ts")).repartition("date").sortWithinPartitions("date", *CELL)
    written = store.stage("health", merged, store.version(state), ("date",))
    others = [f for f in state.tables["health"].folders if not touched(f)] if stored is not None else []
    return store.commit(state, {"health": Table(tuple(sorted([*others, *written.folders])), written.schema)})


def add_attempts(attempts: DataFrame, root: str, part: str, grain_hours: int) -> State:
    """A13, incrementally: the sums of one part of the attempts (a file, an hour, a micro-batch) are stored beside those
    of the parts before. Only the part itself is read. A part that is added again replaces its first attempt."""
    store = Snapshots(attempts.sparkSession, root)
    state = store.state()
    parts = dict(state.notes.get("rollup_parts", {}))
    if parts.get(part) == COMPACTED:
        raise ValueError(f"part {part} was added and compacted already")
    version = store.version(state)
    sums = cell_sums(attempts, grain_hours).withColumn("date", F.to_date("ts"))
    new = store.stage("cell_sums", sums, version, ("date",))
    old = state.tables["cell_sums"].folders if "cell_sums" in state.tables else ()
    again = f"v={parts.get(part)}/"
    return store.commit(state, {"cell_sums": Table(tuple(sorted([*(f for f in old if not f.startswith(again)), *new.folders])), new.schema)},
                        {"rollup_parts": {**parts, part: version}})


COMPACTED = "compacted"


def stored_sums(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored sums, one row per cell."""
    sums = read_table(spark, root, "cell_sums")
    return None if sums is None else merge_sums(sums)


def stored_rollup(spark: SparkSession, root: str) -> DataFrame | None:
    """The health series of all parts added so far."""
    sums = stored_sums(spark, root)
    return None if sums is None else health_of(sums)


def compact_rollup(spark: SparkSession, root: str) -> State:
    """One version per day in place of one per part; only days that hold several are written anew."""
    store = Snapshots(spark, root)
    state = store.state()
    if "cell_sums" not in state.tables:
        return state
    folders = state.tables["cell_sums"].folders
    days = [f.split("/")[-1] for f in folders]
    many = {d for d in days if days.count(d) > 1}
    if not many:
        return state
    sums = store.read("cell_sums", state, lambda f: f.split("/")[-1] in many)
    merged = merge_sums(sums).withColumn("date", F.to_date("ts")).repartition("date").sortWithinPartitions("date", *CELL)
    new = store.stage("cell_sums", merged, store.version(state), ("date",))
    kept = [f for f in folders if f.split("/")[-1] not in many]
    parts = {k: COMPACTED for k in state.notes.get("rollup_parts", {})}
    return store.commit(state, {"cell_sums": Table(tuple(sorted([*kept, *new.folders])), new.schema)}, {"rollup_parts": parts})


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return Snapshots(spark, root).read(name)


def write_run(wide: DataFrame, root: str, run_id: str, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The wide frame is written once (lineage cut), then projected into the four run tables, committed
    together with the keys of its outcomes. Folders of an earlier attempt of ``run_id`` are let go, also those of
    policies that the new attempt has no rows for."""
    w = cut_lineage(wide, f"run-{run_id}")
    audit = audit_ops.audit_rows(w)
    if events is not None:
        audit = audit.unionByName(audit_ops.event_audit_rows(events))
    out = {
        "decisions": views.decisions_table(w),
        "actions_taken": views.actions_table(w),
        "outcomes": views.outcomes_table(w),
        "audit_log": audit,
    }
    store = Snapshots(w.sparkSession, root)
    state = store.state()
    escape = w.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    version, mine, tables = store.version(state), f"run_id={escape(run_id)}", {}
    for name, df in out.items():
        rows = df.withColumn("policy", F.coalesce(F.col("policy"), F.lit("none"))).withColumn("run_id", F.lit(run_id))
        new = store.stage(name, rows, version, ("run_id", "policy"))
        before = [f for f in state.tables[name].folders if f.split("/")[1] != mine] if name in state.tables else []
        tables[name] = Table((*before, *new.folders), new.schema)
    keys, notes = outcome_index.stage(store, state, version, out["outcomes"], run_id)
    store.commit(state, {**tables, **keys}, notes)
    return {"wide": w, **out}


def prior_outcomes(spark: SparkSession, root: str, run_id: str, batch: DataFrame, policies) -> DataFrame | None:
    """(transaction_id, policy) of the batch that another run already stored, by the key index."""
    pairs = batch.select("transaction_id").distinct().withColumn("policy", F.explode(F.array(*[F.lit(x) for x in policies])))
    return outcome_index.known(Snapshots(spark, root), pairs, run_id)


def run_and_store(spark: SparkSession, linked: DataFrame, root: str, run_id: str, p: Params = Params(),
                  policies=("baseline", "agent"), events: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run the policies, skipping (transaction, policy) pairs that already have a stored outcome."""
    prior = prior_outcomes(spark, root, run_id, linked, policies)
    wide = run_all(linked, p, policies, prior_outcomes=prior)
    return write_run(wide, root, run_id, events)


def reload_diagnosis(spark: SparkSession, root: str, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """A10: finished diagnosis from one state of the storage (events, transactions). The transactions are linked to
    the stored events again, so they carry the context the policies read (peer, window, statement)."""
    store = Snapshots(spark, root)
    state = store.state()
    events, txns = store.read("degradation_events", state), store.read("transactions", state)
    linked = link(txns.drop("event_id", "degradation_linked"), events, p, carry=RC_CARRY + ("window_end",))
    return events, linked.withColumnRenamed("window_end", "event_window_end")


def export_audit(spark: SparkSession, root: str, path: str) -> None:
    """The whole audit log as JSON lines, newest first."""
    audit_ops.export_audit(read_table(spark, root, "audit_log"), path)
