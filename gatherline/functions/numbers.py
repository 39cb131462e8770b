"""Rounding, clamping and order-independent sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Round with plain IEEE steps, so that any SQL engine can repeat them.

    Differs from half-even rounding of the binary value only at exact ties.
    """
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def fixed_point(x: Column, digits: int = 9) -> Column:
    """``x`` as a whole number of 10^-digits."""
    return F.floor(x * float(10**digits) + 0.5)


def exact_sum(x: Column, digits: int = 9) -> Column:
    """Sum in fixed point, as a decimal whole number.

    Sums of doubles depend on the order of partial aggregates; this does not, so
    a retried or differently partitioned job gives the same bits. The sum has room
    for 10^10 values of the largest size a bigint holds.
    """
    return F.sum(fixed_point(x, digits).cast("decimal(28,0)"))


def small_exact_sum(x: Column, digits: int = 9) -> Column:
    """The same sum for groups of at most 2^31 rows, made of two bigint sums: decimals, at a row each, take far longer.

    Decimals come in only where the sum is too large for a bigint.
    """
    value = fixed_point(x, digits)
    high, low = F.sum(F.shiftright(value, 32)), F.sum(value.bitwiseAND(F.lit((1 << 32) - 1)))
    fits = (high > -(1 << 30)) & (high < (1 << 30)) & (low < (1 << 62))
    large = high.cast("decimal(28,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(28,0)")
    return F.when(fits, (F.shiftleft(high, 32) + low).cast("double")).otherwise(large.cast("double"))


def mean_of(total: Column, count: Column, digits: int = 9) -> Column:
    return total.cast("double") / (count * float(10**digits))


def exact_mean(x: Column, digits: int = 9) -> Column:
    return mean_of(exact_sum(x, digits), F.count(x), digits)


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))
