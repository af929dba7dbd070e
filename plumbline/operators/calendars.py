"""Research calendars, as configuration lists and as columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_start(day: date, shift: int = 0) -> date:
    months = day.year * 12 + day.month - 1 + shift
    return date(months // 12, months % 12 + 1, 1)


def rebalance_windows(start: date, end: date, months: int = 3) -> list[tuple[date, date]]:
    """(start, end) of each holding window; the last one ends at `end`."""
    first = start if start.day == 1 else month_start(start, 1)
    starts = []
    while first <= end:
        starts.append(first)
        first = month_start(first, months)
    return holding_windows(starts, end)


def holding_windows(starts: Sequence[date], end: date) -> list[tuple[date, date]]:
    starts = sorted(set(starts))
    ends = [s - timedelta(days=1) for s in starts[1:]] + [end]
    return list(zip(starts, ends))


def training_dates(current: date, periods: int = 12, months: int = 3) -> list[date]:
    """Month starts `months` apart, the last one `months` before `current`."""
    last = month_start(current, -months)
    return [month_start(last, -months * k) for k in reversed(range(periods))]


def boundaries(current: date, periods: int = 12, months: int = 3) -> list[date]:
    """Training dates plus the current date, so no label passes it."""
    return sorted({*training_dates(current, periods, months), current})


def window_rows(spans: DataFrame, start: str, end: str, months: int = 3) -> DataFrame:
    """Rebalance windows of every (start, end) row."""
    first = F.when(F.dayofmonth(start) == 1, F.col(start)).otherwise(
        F.trunc(F.add_months(start, 1), "month")
    )
    step = F.expr(f"interval {months} months")
    starts = F.when(first <= F.col(end), F.sequence(first, F.col(end), step))
    rows = spans.withColumn("start_date", F.explode(starts))
    following = F.add_months("start_date", months)
    return rows.withColumn(
        "end_date", F.when(following <= F.col(end), F.date_sub(following, 1)).otherwise(F.col(end))
    )


def training_array(current: Column, periods: int = 12, months: int = 3) -> Column:
    last = F.trunc(F.add_months(current, -months), "month")
    return F.sequence(
        F.add_months(last, -months * (periods - 1)), last, F.expr(f"interval {months} months")
    )


def next_dates(dates: DataFrame, column: str = "date") -> DataFrame:
    """Distinct dates with the following one; one row per calendar day at most."""
    days = dates.select(column).distinct()
    return days.withColumn("next_date", F.lead(column).over(Window.partitionBy().orderBy(column)))
