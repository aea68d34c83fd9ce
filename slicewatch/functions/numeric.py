"""Exact aggregation and rounding helpers.

Doubles are summed as DECIMAL so the result does not depend on partitioning or row order
(and equals what any SQL engine computes from the same rows); the final division happens once,
in double precision. Rounding judges the exact value of the binary double, as printf and Python do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE_DEC = "decimal(12,10)"      # success rates in [0, 1]
VALUE_DEC = "decimal(30,12)"     # latencies, baselines, z-scores
MONEY_DEC = "decimal(18,2)"      # rupees


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c, dec: str = VALUE_DEC) -> Column:
    return F.sum(col(c).cast(dec))


def safe_div(num: Column, den: Column) -> Column:
    """num / den in double, null when den is 0 or null (ANSI mode throws on /0)."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def exact_mean(c, dec: str = VALUE_DEC) -> Column:
    return safe_div(exact_sum(c, dec), F.count(col(c)))


_WHOLE = "decimal(38,0)"


def round_double(c, digits: int) -> Column:
    """H5: the double nearest to the exact value of ``c`` rounded to ``digits`` (0 to 9) places, half to even.

    2.675 is a double a little below 2.675 and becomes 2.67; 0.125 is exact and becomes 0.12. The double is
    m / 2^s with whole m and s; m * 10^digits is divided by 2^s in DECIMAL with its exact remainder. Doubles of
    2^52 and more are whole numbers and stay; below 2^-60 the result is zero; null, NaN and infinities stay."""
    x = col(c).cast("double")
    size = F.abs(x)
    s = F.lit(54) - F.floor(F.log2(size)).cast("int")             # m = x * 2^s has 54 or 55 bits
    m = (size * F.pow(F.lit(2.0), s)).cast("bigint").cast(_WHOLE)
    num = m * F.lit(10 ** digits).cast("decimal(10,0)")
    half = F.call_function("div", s, F.lit(2)).cast("int")
    one = F.lit(1).cast("bigint")
    power = (F.call_function("shiftleft", one, half).cast("decimal(19,0)")
             * F.call_function("shiftleft", one, s - half).cast("decimal(19,0)")).cast(_WHOLE)
    parts = F.struct(num.cast(_WHOLE).alias("num"), power.alias("den"))
    with_rest = F.transform(F.array(parts), lambda p: F.struct(p["num"].alias("num"), p["den"].alias("den"), (p["num"] % p["den"]).alias("rest")))

    def up(p: Column) -> Column:
        whole = ((p["num"] - p["rest"]) / p["den"]).cast(_WHOLE)
        over = p["rest"] * 2 - p["den"]
        more = (over > 0) | ((over == 0) & (whole % 2 == 1))
        return ((whole + more.cast("int").cast("decimal(1,0)")).cast("decimal(28,0)") / F.lit(10 ** digits).cast("decimal(10,0)")).cast("double")
    rounded = F.transform(with_rest, up)[0]
    small = size < F.lit(2.0 ** -60)
    moved = F.when(small, F.lit(0.0)).otherwise(rounded)
    stays = x.isNull() | F.isnan(x) | (size >= F.lit(2.0 ** 52))
    return F.when(stays, x).when(x < 0, -moved).otherwise(moved)


def clip(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def whole_percent(rate) -> Column:
    """Rate in [0,1] → whole-percent text, ties to even (as printf-style %.0f on doubles)."""
    return F.bround(col(rate) * F.lit(100.0), 0).cast("bigint").cast("string")
