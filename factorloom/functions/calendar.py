"""Dates: month ends, offsets by frequency, calendars as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIODS_PER_YEAR = {"b": 252, "m": 12}


def month_end(date: Column) -> Column:
    return F.last_day(date)


def month_ends_ahead(date: Column, k) -> Column:
    """The k-th month end after a date (before it, for negative k); a month end counts as passed."""
    k = F.lit(k) if isinstance(k, int) else k
    back = F.when((k > 0) & (date != F.last_day(date)), k - 1).otherwise(k)
    return F.last_day(F.add_months(date, back))


def offset(date: Column, frequency: str, k: int = 1) -> Column:
    """A date moved by k periods: days, weekdays, weeks, month ends or year ends. Days of an exchange need a calendar."""
    if frequency == "d":
        return F.date_add(date, k)
    if frequency == "b":
        day = F.weekday(date)  # from a weekend the way begins at its Friday, back at its Monday
        start, of = (F.date_sub(date, F.greatest(day - 4, F.lit(0))), F.least(day, F.lit(4))) if k > 0 else (
            F.when(day > 4, F.date_add(date, F.lit(7) - day)).otherwise(date), F.when(day > 4, 0).otherwise(day))
        return F.date_add(start, (F.lit(k) + 2 * F.floor((of + k) / 5)).cast("int"))
    if frequency == "w":
        return F.date_add(date, 7 * k)
    if frequency == "m":
        return month_ends_ahead(date, k)
    if frequency == "y":
        year_end = F.make_date(F.year(date), F.lit(12), F.lit(31))
        steps = k - 1 if k > 0 else k
        moved = F.make_date(F.year(date) + F.lit(steps), F.lit(12), F.lit(31))
        return F.when((date == year_end) & F.lit(k > 0), F.add_months(moved, 12)).otherwise(moved)
    raise NotImplementedError(f"no offset for frequency {frequency!r}")


def is_period_end(date: Column, frequency: str) -> Column:
    """Whether a date ends a period: every day, weekdays, Sundays, month ends, year ends."""
    if frequency == "d":
        return date.isNotNull()
    if frequency == "b":
        return F.weekday(date) < 5
    if frequency == "w":
        return F.weekday(date) == 6
    if frequency == "m":
        return date == F.last_day(date)
    if frequency == "y":
        return (F.month(date) == 12) & (F.dayofmonth(date) == 31)
    raise NotImplementedError(f"no periods of frequency {frequency!r}")


def numbered(dates: DataFrame) -> DataFrame:
    """A calendar (date, pos) of the distinct dates; pos counts from 0."""
    return dates.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def business_days_ahead(rows: DataFrame, calendar: DataFrame, k: int, name: str = "moved") -> DataFrame:
    """rows with the calendar date k positions after `date`; null off or beyond the calendar."""
    there = calendar.select(F.col("date").alias(name), (F.col("pos") - k).alias("pos"))
    return rows.join(calendar, "date", "left").join(there, "pos", "left").drop("pos")


def month_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Month ends from the month of start to that of end."""
    ends = F.sequence(F.last_day(F.lit(start).cast("date")), F.last_day(F.lit(end).cast("date")), F.expr("interval 1 month"))
    return numbered(spark.range(1).select(F.explode(ends).alias("d")).select(F.last_day("d").alias("date")))
