"""As-of selection against a list of research dates.

The dates are configuration (tens of values), so instead of joining, each row
expands to exactly the research dates it answers. The row count after the
expansion equals the answer size; no join, no cross product.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from plumbline.functions.scalars import date_array


def latest_rows(
    rows: DataFrame,
    dates: Sequence[date],
    key: str = "ticker",
    order: str = "date",
    as_of: str = "as_of_date",
) -> DataFrame:
    """Last row at or before each date, per key.

    A row is valid on [its date, date of the key's next row). The lead runs over
    the window the price measures already use, so it adds no shuffle.
    """
    return answering(with_validity(rows.filter(F.col(order) <= F.lit(max(dates))), key, order), dates, order, as_of)


def with_validity(rows: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds _valid_to, the date of the key's next row."""
    return rows.withColumn("_valid_to", F.lead(order).over(Window.partitionBy(key).orderBy(order)))


def answered(dates: Sequence[date], order: str = "date") -> Column:
    """The dates that a row `with_validity` answers."""
    return F.filter(
        date_array(dates),
        lambda d: (d >= F.col(order)) & (F.col("_valid_to").isNull() | (d < F.col("_valid_to"))),
    )


def answers(dates: Sequence[date], order: str = "date") -> Column:
    """True where a row `with_validity` answers any of the dates: comparisons alone, no array is built for a row."""
    some = F.lit(False)
    for day in sorted(set(dates)):
        some = some | ((F.lit(day) >= F.col(order)) & (F.col("_valid_to").isNull() | (F.lit(day) < F.col("_valid_to"))))
    return F.coalesce(some, F.lit(False))


def answering(rows: DataFrame, dates: Sequence[date], order: str = "date", as_of: str = "as_of_date") -> DataFrame:
    """Rows `with_validity`, each for the dates it answers."""
    return rows.withColumn(as_of, F.explode(answered(dates, order))).drop("_valid_to")


def visible_rows(
    rows: DataFrame,
    dates: Sequence[date],
    known_on: Column | str = "filed_date",
    as_of: str = "as_of_date",
) -> DataFrame:
    """Every row known on or before each date (NULL known_on is dropped)."""
    known = F.col(known_on) if isinstance(known_on, str) else known_on
    return rows.filter(known <= F.lit(max(dates))).withColumn(
        as_of, F.explode(F.filter(date_array(dates), lambda d: d >= known))
    )


def rows_in_windows(
    rows: DataFrame,
    windows: Sequence[tuple[date, date]],
    on: str = "date",
) -> DataFrame:
    """Rows falling inside inclusive (start, end) windows, with both bounds.

    A date finds its windows in a calendar of one row per window and day, which is broadcast.
    """
    spans = F.array(
        *[
            F.struct(F.lit(start).alias("start_date"), F.lit(end).alias("end_date"))
            for start, end in windows
        ]
    )
    if isinstance(rows.schema[on].dataType, DateType):
        listed = rows.sparkSession.range(1).select(F.explode(spans).alias("_span")).select("_span.*")
        days = F.explode(F.sequence("start_date", "end_date")).alias("_day")
        calendar = listed.filter("start_date <= end_date").select(days, "start_date", "end_date")
        return rows.join(F.broadcast(calendar), rows[on] == F.col("_day")).drop("_day")
    low = min(start for start, _ in windows)
    high = max(end for _, end in windows)
    return (
        rows.filter(F.col(on).between(F.lit(low), F.lit(high)))
        .withColumn(
            "_span",
            F.explode(
                F.filter(spans, lambda s: F.col(on).between(s["start_date"], s["end_date"]))
            ),
        )
        .select(rows["*"], "_span.start_date", "_span.end_date")
    )
