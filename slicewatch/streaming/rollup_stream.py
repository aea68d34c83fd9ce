"""Tumbling slice rollup of a payment-attempt stream, with watermark and late-data drop.

The watermark needs a zoned TIMESTAMP, so ``ts`` (TIMESTAMP_NTZ) becomes the instant whose UTC wall
clock it is, and cell starts are turned back the same way: results do not depend on the session
time zone. Append mode emits a cell once the watermark passes its end;
rows later than the watermark are dropped, so every emitted cell is final. ``open_cells`` gives the
cells that the end of the input would close, out of the stream's own state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.functions.timeutil import epoch_micros, from_epoch_micros
from slicewatch.operators.rollup import SUM_DEC, SUMS, health_of
from slicewatch.session import ensure_checkpoint_dir
from slicewatch.sources.payments import attempts_from_events


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def as_stream_path(spark: SparkSession, path: str) -> str:
    """The file source lists a directory or a glob; a single file becomes a one-file glob."""
    head, _, name = path.rstrip("/").rpartition("/")
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if name.endswith(".parquet") and fs.getFileStatus(hpath).isFile():
        return f"{head}/[{name[0]}]{name[1:]}"
    return path


def events_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    schema = spark.read.parquet(path).schema          # footer read only
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(as_stream_path(spark, path))


def rollup_stream(attempts: DataFrame, grain_hours: int, delay: str | None = None) -> DataFrame:
    delay = delay or f"{int(grain_hours)} hours"
    # zoned instant whose UTC wall clock is ts (independent of the session time zone)
    a = attempts.withColumn("ts_z", F.timestamp_micros(epoch_micros("ts"))).withWatermark("ts_z", delay)
    agg = a.groupBy("payment_method", "bank_gateway", F.window("ts_z", f"{int(grain_hours)} hours").alias("cell")).agg(
        F.count(F.lit(1)).alias("transaction_volume"),
        F.sum(F.col("ok").cast("int")).alias("n_ok"),
        F.count("ok").alias("n_known"),
        F.sum(F.col("latency_ms").cast("decimal(30,6)")).cast(SUM_DEC).alias("lat_sum"),
        F.count("latency_ms").alias("n_lat"),
    )
    return health_of(agg.select("payment_method", "bank_gateway", from_epoch_micros(F.unix_micros(F.col("cell.start"))).alias("ts"), *SUMS))


#: The state's buffers, in the order of the aggregates above (a decimal sum keeps a flag beside it).
STATE = "struct<transaction_volume:bigint,n_ok:bigint,n_known:bigint,lat_sum:decimal(38,6),no_lat:boolean,n_lat:bigint>"


def open_cells(spark: SparkSession, sink: str) -> DataFrame:
    """Cells that the stream into ``sink`` still holds back, as its last batch left them in the state store; the attempts
    are not read again. Without a batch there are none."""
    path = f"{sink}-ckpt"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state/0")
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        return health_of(spark.createDataFrame([], "payment_method string, bank_gateway string, ts timestamp_ntz, transaction_volume long, "
                                               f"n_ok long, n_known long, lat_sum {SUM_DEC}, n_lat long"))
    state = spark.read.format("statestore").load(path).withColumn("sums", F.col("value").cast(STATE))
    known = F.when(~F.col("sums.no_lat"), F.col("sums.lat_sum"))
    sums = [known.alias(c) if c == "lat_sum" else F.col(f"sums.{c}").alias(c) for c in SUMS]
    start = from_epoch_micros(F.unix_micros(F.col("key.window.start")))
    return health_of(state.select("key.payment_method", "key.bank_gateway", start.alias("ts"), *sums))


def run_rollup(spark: SparkSession, events_path: str, grain_hours: int, sink: str | None = None,
               delay: str | None = None, max_files_per_trigger: int | None = None) -> str:
    """Replay ``events_path`` through the streaming rollup (availableNow) into a parquet sink."""
    sink = sink or scratch(spark, "health")
    q = (rollup_stream(attempts_from_events(events_stream(spark, events_path, max_files_per_trigger)), grain_hours, delay)
         .writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", sink + "-ckpt").option("path", sink)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
