"""S3 + S4: stream–static interval linkage and an exactly-once decision sink (foreachBatch).

Each micro-batch of failed payments is linked against the events table, re-read per batch (a diagnosis job may
refresh it between batches). The sink is a versioned store: a batch commits its linked rows, the rows that
found no event and its number together, so a replayed batch changes nothing. Rows without an event wait, by
day. When events appear that the sink has not seen, the waiting rows of the days those events cover are
tried against the new events alone; other days are not read. ``read_linked`` gives both, and after
the events are complete it equals the batch linkage, whichever came first. Event ids must not change meaning
between refreshes, and of overlapping events the first one seen keeps its transactions.

The decision sink runs both policies per batch, skipping (transaction, policy) pairs that already hold an outcome
from earlier batches, on whatever day (the key index of the store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.operators.linkage import link, with_after_recovery_probability
from slicewatch.params import Params
from slicewatch.plans.diagnose import RC_CARRY
from slicewatch.plans.run import run_all
from slicewatch.session import cut_lineage
from slicewatch.sources import store
from slicewatch.sources.payments import attempts_from_events, transactions_from_attempts
from slicewatch.sources.snapshots import Snapshots, State, Table
from slicewatch.streaming.rollup_stream import events_stream, scratch


def _linked(batch: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    carry = tuple(c for c in RC_CARRY if c in events.columns) + ("window_end",)
    out = link(batch, events, p, carry=carry).withColumnRenamed("window_end", "event_window_end")
    return with_after_recovery_probability(out)


#: Columns that linkage adds to a transaction.
ADDED = (*RC_CARRY, "event_window_end", "event_id", "degradation_linked", "ground_truth_recovery_probability_after_recovery", "date")


def _match(rows: DataFrame, events: DataFrame, p: Params, name: str) -> DataFrame:
    return cut_lineage(_linked(rows, events, p).withColumn("date", F.to_date("ts")), name)


def _new_events(store: Snapshots, state: State, events: DataFrame) -> DataFrame:
    window = ["payment_method", "bank_gateway", "window_start", "window_end"]
    seen = store.read("events_seen", state)
    return events if seen is None else events.join(seen, window, "left_anti")


def _keep(store: Snapshots, state: State, fresh: DataFrame | None, events: DataFrame, p: Params, notes: dict) -> None:
    """One commit: the new rows and the waiting rows that new events may hold, linked or still waiting."""
    version, tables = store.version(state), {}
    added = cut_lineage(_new_events(store, state, events), "new-events")
    days = {f"date={r[0]}" for r in added.where("window_start < window_end").select(F.explode(F.sequence(
        F.to_date("window_start"), F.to_date(F.col("window_end") - F.expr("INTERVAL 1 MICROSECOND")))).alias("d")).distinct().collect()}
    touched = lambda f: f.split("/")[-1] in days
    folders = {name: list(state.tables[name].folders) if name in state.tables else [] for name in ("linked", "waiting", "events_seen")}
    found = [] if fresh is None else [_match(fresh, events, p, "fresh")]
    if any(map(touched, folders["waiting"])):
        waiting = store.read("waiting", state, touched)
        folders["waiting"] = [f for f in folders["waiting"] if not touched(f)]
        found.append(_match(waiting.drop(*ADDED), added, p, "again"))
    if found:
        rows = found[0] if len(found) == 1 else found[0].unionByName(found[1].select(*found[0].columns))
        for name, part in (("linked", rows.where("degradation_linked")), ("waiting", rows.where("not degradation_linked"))):
            new = store.stage(name, part, version, ("date",))
            tables[name] = Table(tuple(sorted([*folders[name], *new.folders])), new.schema)
    if days or "events_seen" not in state.tables:
        new = store.stage("events_seen", added.select("payment_method", "bank_gateway", "window_start", "window_end"), version)
        tables["events_seen"] = Table((*folders["events_seen"], *new.folders), new.schema)
    if tables or notes:
        store.commit(state, tables, notes)


def run_link_stream(spark: SparkSession, events_path: str, events_table: str, p: Params, sink: str | None = None,
                    max_files_per_trigger: int | None = None) -> str:
    """S3: every failed payment of the stream, linked now or when its event appears; read it with ``read_linked``."""
    sink = sink or scratch(spark, "linked")
    txns = transactions_from_attempts(attempts_from_events(events_stream(spark, events_path, max_files_per_trigger)))
    store = Snapshots(spark, sink)

    def on_batch(df: DataFrame, batch_id: int) -> None:
        state = store.state()
        if state.notes.get("batch", -1) >= batch_id:      # committed before the stream noted it
            return
        _keep(store, state, df, spark.read.parquet(events_table), p, {"batch": batch_id})

    q = (txns.writeStream.foreachBatch(on_batch).option("checkpointLocation", sink + "-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def link_waiting(spark: SparkSession, events_table: str, sink: str, p: Params) -> None:
    """Try the waiting rows against events that appeared after the last micro-batch."""
    store = Snapshots(spark, sink)
    state = store.state()
    if "waiting" in state.tables:
        _keep(store, state, None, spark.read.parquet(events_table), p, {})


def read_linked(spark: SparkSession, sink: str) -> DataFrame | None:
    """All rows of the stream so far, those without an event included; one state of the sink."""
    store = Snapshots(spark, sink)
    state = store.state()
    linked, waiting = store.read("linked", state), store.read("waiting", state)
    return None if linked is None else linked.unionByName(waiting).drop("date")


def run_decision_stream(spark: SparkSession, events_path: str, events_table: str, root: str, p: Params,
                        policies=("baseline", "agent"), max_files_per_trigger: int | None = None) -> str:
    """Link, decide, enforce, execute per batch; run tables stored exactly once per batch."""
    txns = transactions_from_attempts(attempts_from_events(events_stream(spark, events_path, max_files_per_trigger)))

    def on_batch(df: DataFrame, batch_id: int) -> None:
        run_id = f"b{batch_id:08d}"
        events = spark.read.parquet(events_table)
        prior = store.prior_outcomes(spark, root, run_id, df, policies)   # a replay must not see its own first attempt
        wide = run_all(_linked(df, events, p), p, policies, prior_outcomes=prior)
        store.write_run(wide, root, run_id)

    q = (txns.writeStream.foreachBatch(on_batch).option("checkpointLocation", root.rstrip("/") + "/_stream-ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return root
