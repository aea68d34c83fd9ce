"""Timestamp helpers for TIMESTAMP_NTZ columns (no session time zone involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _wall_seconds(ts: Column) -> Column:
    """Whole seconds of the wall-clock value since 1970-01-01 00:00, from date parts only: a zoned
    difference would move values inside a daylight-saving gap of the session time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60


def epoch_seconds(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return _wall_seconds(ts) + F.second(ts)


def epoch_micros(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    # date_part('SECOND') is seconds with the fraction, DECIMAL(8,6): exact micros
    return _wall_seconds(ts) * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def from_epoch_seconds(secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs, _epoch())


def add_hours(ts, hours) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("HOUR", F.lit(int(hours)), ts)


def bucket_of(ts, bucket_seconds: int) -> Column:
    """Epoch-aligned bucket number of a timestamp."""
    return F.floor(epoch_seconds(ts) / F.lit(bucket_seconds)).cast("bigint")


def buckets_covering(start, end, bucket_seconds: int) -> Column:
    """Array of bucket numbers touched by the half-open interval [start, end)."""
    first = bucket_of(start, bucket_seconds)
    last = F.floor((epoch_micros(end) - F.lit(1)) / F.lit(bucket_seconds * 1_000_000)).cast("bigint")
    return F.sequence(first, F.greatest(first, last))
