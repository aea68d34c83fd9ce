"""Detection backtest — labelled outage windows against detected events.

A label is hit when an event of the same slice overlaps it (``ds < le AND de > ls``); among
several, the one whose start is nearest the label's start wins (ties: lower event id). Two windows overlap
when one's start lies in the other, so the pairs are two point-in-interval joins over hierarchical pieces: every
pair is found once, by equality, and a window of years costs some dozens of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewatch.functions.intervals import block_of, with_pieces
from slicewatch.functions.timeutil import add_hours, epoch_micros
from slicewatch.operators.baseline import SLICE


def labels_from_slices(health: DataFrame, first_start: str = "2024-01-03 06:00:00", days: int = 7) -> DataFrame:
    """Test-data labels: one window per slice, start = first_start + (m·6 + g) days, ``days`` long."""
    s = health.select(*SLICE).distinct()
    m = F.substring("payment_method", 2, 10).cast("int")
    g = F.substring("bank_gateway", 2, 10).cast("int")
    start = F.timestamp_add("DAY", m * 6 + g, F.lit(first_start).cast("timestamp_ntz"))
    return s.select(*SLICE, start.alias("label_start"), add_hours(start, 24 * days).alias("label_end"))


def _holding(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of the same slice with ``lo <= at < hi``: each point is spread over the levels that the pieces use."""
    pieces = with_pieces(intervals, "lo", "hi")
    used = sorted(r[0] for r in pieces.select("level").distinct().collect())         # at most 13
    if not used:
        used = [0]
    spread = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in used])))
    spread = spread.withColumn("block", block_of(F.col("at"), F.col("level")))
    return spread.join(pieces.drop("lo", "hi"), [*SLICE, "level", "block"]).drop("level", "block")


def overlapping(labels: DataFrame, events: DataFrame) -> DataFrame:
    """(slice, label_start, event_id, window_start) of every overlapping pair, once each."""
    lb = labels.select(*SLICE, "label_start", epoch_micros("label_start").alias("lo"), epoch_micros("label_end").alias("hi")).distinct()
    ev = events.select(*SLICE, "event_id", "window_start", epoch_micros("window_start").alias("lo"), epoch_micros("window_end").alias("hi"))
    columns = [*SLICE, "label_start", "event_id", "window_start"]
    event_in_label = _holding(lb, ev.where("lo < hi").withColumnRenamed("lo", "at").drop("hi")).select(*columns)
    label_in_event = _holding(ev, lb.where("lo < hi").withColumnRenamed("lo", "at").drop("hi")).where(
        F.col("window_start") < F.col("label_start")).select(*columns)
    return event_in_label.unionByName(label_in_event)


def backtest(labels: DataFrame, events: DataFrame) -> DataFrame:
    away = F.abs(epoch_micros("window_start") - epoch_micros("label_start")).alias("away")
    near = F.min(F.struct(away, F.col("event_id"), F.col("window_start")))
    best = overlapping(labels, events).groupBy(*SLICE, "label_start").agg(near.alias("_n")).select(
        *SLICE, "label_start", F.col("_n.event_id").alias("matched_event_id"), F.col("_n.window_start").alias("matched_start"))
    return labels.join(best, [*SLICE, "label_start"], "left").withColumn("hit", F.col("matched_event_id").isNotNull())


def backtest_summary(result: DataFrame, events: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels, hits, misses, recall; precision = events overlapping any label / events."""
    matched_events = overlapping(labels, events).select("event_id").distinct()
    r = result.agg(F.count(F.lit(1)).alias("labels"), F.count_if("hit").alias("hits"))
    e = events.agg(F.count(F.lit(1)).alias("events"))
    me = matched_events.agg(F.count(F.lit(1)).alias("events_on_labels"))
    one = F.lit(1)
    out = r.withColumn("_k", one).join(e.withColumn("_k", one), "_k").join(me.withColumn("_k", one), "_k").drop("_k")
    return out.select(
        "labels", "hits", (F.col("labels") - F.col("hits")).alias("missed"), "events", "events_on_labels",
        F.when(F.col("labels") > 0, F.col("hits") / F.col("labels")).alias("recall"),
        F.when(F.col("events") > 0, F.col("events_on_labels") / F.col("events")).alias("precision"),
    )
