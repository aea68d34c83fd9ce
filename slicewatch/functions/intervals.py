"""Hierarchical pieces of half-open intervals: points find their intervals by equality, one key per level.

An interval of whole numbers [lo, hi) is the union of aligned blocks of 1, b, b², ... numbers; the largest blocks
that fit are its pieces, at most 2 (b - 1) per level, so their number grows with the logarithm of the length. A
point lies in one block per level: it meets every interval that holds it by equality on (level, block), and
each of them once. The base b is a power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4             # b = 16
LEVELS = 13          # 16^13 microseconds are 142 years; of longer intervals, blocks of the last level are listed one by one


def _shift(level: Column, bits: int) -> Column:
    return (level * bits).cast("int")


def _down(x: Column, shift: Column) -> Column:
    return F.call_function("shiftright", x, shift)


def _up(x: Column, shift: Column) -> Column:
    return -F.call_function("shiftright", -x, shift)


def with_pieces(df: DataFrame, lo: str, hi: str, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Every row once per piece of [lo, hi), with ``level`` and ``block``; rows of empty or missing intervals go."""
    level, s = F.col("level"), _shift(F.col("level"), bits)
    at = df.where(F.col(lo) < F.col(hi)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    ends = at.withColumns({"_first": _up(F.col(lo), s), "_end": _down(F.col(hi), s),
                           "_a": F.shiftleft(_up(F.col(lo), _shift(level + 1, bits)), bits),
                           "_b": F.shiftleft(_down(F.col(hi), _shift(level + 1, bits)), bits)}).where("_first < _end")
    inside = (F.col("_a") < F.col("_b")) & (level + 1 < levels)      # what the blocks of the next level cover is theirs
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    blocks = F.when(inside, F.concat(run(F.col("_first"), F.col("_a")), run(F.col("_b"), F.col("_end")))).otherwise(
        run(F.col("_first"), F.col("_end")))
    return ends.withColumn("block", F.explode(blocks)).drop("_first", "_end", "_a", "_b")


def block_of(x: Column, level, bits: int = BITS) -> Column:
    """The block of ``level`` that holds the number."""
    level = F.lit(level) if isinstance(level, int) else level
    return _down(x, _shift(level, bits))
