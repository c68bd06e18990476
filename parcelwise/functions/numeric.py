"""Exact ratios rounded to two places, half away from zero.

Spark's own ``avg(decimal)`` keeps four extra digits and rounds there, so rounding
its result to two places rounds twice: a sum of 100.00 over 20,001 rows comes out
as 0.01 where the exact answer is 0.00. Every average and percentage below is
therefore one integer division of hundredths, which is exact at any row count.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONEY = "decimal(30,2)"
_INTEGER = "decimal(38,0)"


def _hundredths(value: Column) -> Column:
    return (value.cast(_MONEY) * 100).cast(_INTEGER)


def cents(amount: Column) -> Column:
    """A ``decimal(12,2)`` amount as a BIGINT of hundredths.

    Sums over item rows run on these: Spark adds wide decimals as objects, but BIGINTs in
    generated code. Twelve digits fit a double's 53 bits, so the step through it is exact.
    """
    return F.rint(amount.cast("decimal(12,2)").cast("double") * 100).cast("bigint")


def sum_cents(amount: Column, bound: Column | None = None) -> Column:
    """Sum of BIGINT hundredths, or an error if it could leave BIGINT, whatever the session says of overflow.

    ``bound``, no smaller than the size of ``amount``, lets several sums share one check. It is added up as
    a double, whose error is far below the margin kept to the largest BIGINT.
    """
    size = F.sum(F.abs(amount if bound is None else bound).cast("double"))
    too_large = F.raise_error("a sum of amounts exceeds 92 quadrillion").cast("bigint")
    return F.when(size > F.lit(9.2e18), too_large).otherwise(F.sum(amount))


def from_cents(total: Column) -> Column:
    """Hundredths back to a two-place decimal."""
    return (total.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")


def round_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` to two places; NULL when the denominator is 0 or NULL.

    Both sides may be counts or decimals of up to two places, below 10**28.
    """
    n = _hundredths(numerator)
    d = F.nullif(_hundredths(denominator), F.lit(0).cast(_INTEGER))
    size = F.call_function("div", F.abs(n) * 200 + F.abs(d), F.abs(d) * 2)
    negative = (n < 0) != (d < 0)
    return from_cents(F.when(negative, -size).otherwise(size))


def pct(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, to two places."""
    return round_ratio(part.cast(_MONEY) * 100, whole)


def average(value: Column) -> Column:
    """Aggregate: mean of the non-NULL values, to two places."""
    return round_ratio(F.sum(value), F.count(value))


def sum_where(value: Column, condition: Column) -> Column:
    """Aggregate: sum over rows meeting ``condition``; NULL when there are none."""
    return F.sum(F.when(condition, value))


def average_where(value: Column, condition: Column) -> Column:
    """Aggregate: mean over rows meeting ``condition``, to two places."""
    return average(F.when(condition, value))
