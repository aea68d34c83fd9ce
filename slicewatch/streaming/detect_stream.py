"""Incremental degradation detection, one micro-batch at a time (``foreachBatch``), in event-time order.

Between batches the stream keeps, per slice, the last ``baseline_rows`` cells, the cells that still wait and
the sums of the run that is open. A batch takes the cells the watermark has passed (largest cell time seen
minus ``delay_hours``), in event-time order whatever order they came in, and puts them through the batch
plan of baseline, breach and islands: the arithmetic is that of the batch job and no Python runs per row.
A run is emitted when a later cell of its slice ends it; ``open_events`` reports what the end of the input
would close. Cells at or before the last processed cell of their slice, and cells without time or slice, are
refused and kept in a table of their own.

State, events and refused cells are tables of a versioned store; a batch commits all of them together with its
number, so a batch that is run again after its commit changes nothing, and one that failed starts from the same state.
The state lies in buckets of slices. A batch reads and writes the buckets of the slices it brings cells for
and those whose first waiting cell the watermark has passed (noted per bucket in the manifest); the folders
of all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewatch.functions.numeric import VALUE_DEC
from slicewatch.functions.timeutil import epoch_micros, epoch_seconds
from slicewatch.operators.baseline import SLICE, with_baseline, with_breach
from slicewatch.operators.events import event_rows, run_means, with_island
from slicewatch.params import Params
from slicewatch.sources.snapshots import Snapshots, Table

SUM_DEC = "decimal(38,12)"
CELL = ("payment_method", "bank_gateway", "ts", "success_rate")
RUN = ("n_rows", "window_start", "last_ts", "s_base", "s_rate", "s_z")
CELL_SCHEMA = "payment_method string, bank_gateway string, ts timestamp_ntz, success_rate double"
OPEN_SCHEMA = ("payment_method string, bank_gateway string, n_rows long, window_start timestamp_ntz, last_ts timestamp_ntz, "
               f"s_base {SUM_DEC}, s_rate {SUM_DEC}, s_z {SUM_DEC}")
EVENT_SCHEMA = ("payment_method string, bank_gateway string, window_start timestamp_ntz, window_end timestamp_ntz, "
                "baseline_rate double, current_rate double, severity string, z_score double, n_rows long")
BUCKETS = 16         # of slices, fixed when a stream begins
HOUR = 3_600_000_000


@dataclass(frozen=True)
class State:
    cells: DataFrame     # CELL and ``waiting``: false for the processed cells a baseline still needs
    open_runs: DataFrame  # one row per slice whose last processed cell breaches


@dataclass(frozen=True)
class Step:
    events: DataFrame
    refused: DataFrame
    state: State


def _missing():
    return F.col("ts").isNull() | F.col("payment_method").isNull() | F.col("bank_gateway").isNull()


def step(new: DataFrame, state: State, p: Params, mark: int | None, keep: Callable[[DataFrame, str], DataFrame],
         final: bool = False) -> Step:
    """One batch up to the watermark ``mark`` (epoch microseconds): ``final`` processes the waiting cells and closes
    every run."""
    done = state.cells.where(~F.col("waiting")).groupBy(*SLICE).agg(F.max("ts").alias("_done"))
    come = keep(new.select(*CELL).join(done, [*SLICE], "left").select(
        *CELL, (_missing() | F.coalesce(F.col("ts") <= F.col("_done"), F.lit(False))).alias("refused")), "come")
    cells = state.cells.unionByName(come.where(~F.col("refused")).select(*CELL, F.lit(True).alias("waiting")))
    ready = F.lit(True) if final else F.lit(False) if mark is None else epoch_micros("ts") <= F.lit(mark)
    passed = cells.where(~F.col("waiting") | ready)

    series = passed.select(*CELL, F.lit(None).cast("double").alias("avg_latency_ms"),
                           F.lit(None).cast("bigint").alias("transaction_volume"))
    flagged = with_breach(with_baseline(series, p, keep_order=True), p)
    fresh = keep(flagged.join(done, [*SLICE], "left").where(F.col("_done").isNull() | (F.col("ts") > F.col("_done")))
                 .drop("_done"), "fresh")
    span = fresh.groupBy(*SLICE).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    found = with_island(fresh, p).where(F.col("breach")).groupBy(*SLICE, "island").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("window_start"), F.max("ts").alias("last_ts"),
        *[F.sum(F.col(c).cast(VALUE_DEC)).cast(SUM_DEC).alias(s) for c, s in (
            ("rolling_baseline_success_rate", "s_base"), ("success_rate", "s_rate"), ("z_score", "s_z"))])

    # a run that begins with the slice's first fresh cell goes on with the open one
    before = state.open_runs.select(*SLICE, F.col("last_ts").alias("_before"))
    goes_on = (F.col("window_start") == F.col("_first")) & F.col("_before").isNotNull()
    if p.strict_gaps:
        goes_on &= epoch_seconds("window_start") - epoch_seconds("_before") <= F.lit(int(p.grain_hours) * 3600)
    placed = (found.join(span, [*SLICE]).join(before, [*SLICE], "left")
              .withColumn("island", F.when(goes_on, F.lit(-1)).otherwise(F.col("island")).cast("bigint")).select(*SLICE, "island", *RUN))
    carried = state.open_runs.select(*SLICE, F.lit(-1).cast("bigint").alias("island"), *RUN)
    runs = placed.unionByName(carried).groupBy(*SLICE, "island").agg(
        F.sum("n_rows").alias("n_rows"), F.min("window_start").alias("window_start"), F.max("last_ts").alias("last_ts"),
        *[F.sum(s).cast(SUM_DEC).alias(s) for s in ("s_base", "s_rate", "s_z")])
    at_end = F.lit(False) if final else F.col("_last").isNull() | (F.col("last_ts") == F.col("_last"))
    runs = keep(runs.join(span, [*SLICE], "left").select(*SLICE, *RUN, at_end.alias("open")), "runs")

    closed = runs.where(~F.col("open")).withColumns({s: F.col(s).cast("double") for s in ("s_base", "s_rate", "s_z")})
    rank = F.row_number().over(Window.partitionBy(*SLICE).orderBy(F.desc("ts")))
    history = passed.withColumn("_k", rank).where(F.col("_k") <= int(p.baseline_rows)).select(*CELL, F.lit(False).alias("waiting"))
    waits = cells.where(F.col("waiting") & ~ready)
    return Step(event_rows(run_means(closed, p), p), come.where(F.col("refused")).select(*CELL),
                State(history.unionByName(waits), runs.where(F.col("open")).select(*SLICE, *RUN)))


def _keeper(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return keep


def _bucket():
    return F.pmod(F.xxhash64(*SLICE), F.lit(BUCKETS)).cast("int")


def _tables(spark: SparkSession, root: str) -> Snapshots:
    return Snapshots(spark, f"{root.rstrip('/')}/tables")


def _of(folder: str) -> str:
    """The bucket of a state folder, as the notes name it."""
    return folder.split("/")[-1].split("=")[1]


def _kept(store: Snapshots, state, buckets: set[str] | None = None) -> State:
    """The kept cells and runs of the given buckets (all by default)."""
    only = None if buckets is None else lambda f: _of(f) in buckets
    cells, open_runs = store.read("cells", state, only), store.read("open", state, only)
    none = store.spark.createDataFrame
    return State(none([], f"{CELL_SCHEMA}, waiting boolean") if cells is None else cells.drop("bucket"),
                 none([], OPEN_SCHEMA) if open_runs is None else open_runs.drop("bucket"))


def _process(store: Snapshots, df: DataFrame, batch_id: int, p: Params, delay_hours: int, keep) -> None:
    state = store.state()
    if state.notes.get("batch", -1) >= batch_id:          # committed before the stream noted it
        return
    come = keep(df.select(*CELL).withColumn("bucket", _bucket()), "batch")
    seen = come.where(~_missing()).agg(F.max(epoch_micros("ts")).alias("newest"), F.collect_set("bucket").alias("buckets")).first()
    newest = max((x for x in (state.notes.get("newest"), seen["newest"]) if x is not None), default=None)
    mark = None if newest is None else newest - int(delay_hours) * HOUR
    waiting = dict(state.notes.get("waiting", {}))
    touched = {str(b) for b in seen["buckets"]} | {b for b, first in waiting.items() if mark is not None and first <= mark}
    done = step(come.drop("bucket"), _kept(store, state, touched), p, mark, keep)

    version, tables = store.version(state), {}
    for name, rows in (("cells", done.state.cells), ("open", done.state.open_runs)):
        new = store.stage(name, rows.withColumn("bucket", _bucket()), version, ("bucket",))
        others = [f for f in state.tables[name].folders if _of(f) not in touched] if name in state.tables else []
        tables[name] = Table(tuple(sorted([*others, *new.folders])), new.schema)
    for name, rows in (("events", done.events), ("refused", done.refused)):
        new = store.stage(name, rows.withColumn("batch_id", F.lit(batch_id).cast("long")), version, ("batch_id",))
        tables[name] = Table((*(state.tables[name].folders if name in state.tables else ()), *new.folders), new.schema)
    fresh = store.read("cells", type(state)(tables={"cells": tables["cells"]}), lambda f: f.startswith(f"v={version}/"))
    firsts = fresh.where("waiting").groupBy("bucket").agg(F.min(epoch_micros("ts")).alias("first")).collect()    # one row per bucket
    waiting = {**{b: x for b, x in waiting.items() if b not in touched}, **{str(r["bucket"]): r["first"] for r in firsts}}
    store.commit(state, tables, {"batch": batch_id, "newest": newest, "waiting": waiting})


def run_detect_stream(spark: SparkSession, health_path: str, root: str, p: Params = Params(), delay_hours: int = 24,
                      max_files_per_trigger: int | None = None) -> str:
    """Detect over the files of ``health_path`` that the stream has not seen yet; ``root`` holds its
    checkpoint, state and events. A cell may come up to ``delay_hours`` after later cells."""
    root = root.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(health_path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    store, keep = _tables(spark, root), _keeper(spark, f"{root}/work")

    def on_batch(df: DataFrame, batch_id: int) -> None:
        _process(store, df, batch_id, p, delay_hours, keep)

    q = (reader.parquet(health_path).writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def emitted(spark: SparkSession, root: str) -> DataFrame:
    """Events the stream has closed."""
    found = _tables(spark, root).read("events")
    return spark.createDataFrame([], EVENT_SCHEMA) if found is None else found.drop("batch_id")


def refused(spark: SparkSession, root: str) -> DataFrame:
    """Cells that came too late, or without time or slice."""
    found = _tables(spark, root).read("refused")
    return spark.createDataFrame([], CELL_SCHEMA) if found is None else found.drop("batch_id")


def open_events(spark: SparkSession, root: str, p: Params = Params()) -> DataFrame:
    """Events that would close if the input ended now: the waiting cells are processed and every open run
    counts, as in the batch job. The stream's own state stays as it is."""
    store = _tables(spark, root)
    none = spark.createDataFrame([], CELL_SCHEMA)
    return step(none, _kept(store, store.state()), p, None, _keeper(spark, f"{root.rstrip('/')}/report"), final=True).events
