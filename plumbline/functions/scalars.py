"""Scalar column helpers with the missing-value rules of the engine.

One missing value: NULL. Division by zero or by NULL gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal ties round differently across engines; results are compared after
# this nudge, see FIXTURES.md.
ROUND_NUDGE = 1e-7


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rnd(value: Column | str, digits: int) -> Column:
    return F.round(col(value) + F.lit(ROUND_NUDGE), digits)


def safe_divide(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(col(numerator), col(denominator))


def growth(current: Column | str, previous: Column | str) -> Column:
    """(current - previous) / |previous|, NULL when previous is 0."""
    return F.try_divide(col(current) - col(previous), F.abs(col(previous)))


def cagr(first: Column | str, last: Column | str, periods: Column | str) -> Column:
    """Compound growth; NULL when undefined over the reals."""
    first, last, periods = col(first), col(last), col(periods)
    valid = (first > 0) & (periods > 0) & (last >= 0)
    return F.when(valid, F.pow(last / first, F.lit(1.0) / periods) - 1)


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL."""
    value = col(value).cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def clip(value: Column | str, low: Column | float, high: Column | float) -> Column:
    """NULL stays NULL (plain least/greatest would skip it)."""
    value = col(value)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def normal_ticker(value: Column | str) -> Column:
    return F.upper(F.trim(col(value)))


def date_array(dates: Sequence[date]) -> Column:
    """Research dates are a short configuration list and ride in the plan."""
    if not dates:
        raise ValueError("at least one date is required")
    return F.array(*[F.lit(d) for d in sorted(set(dates))])
