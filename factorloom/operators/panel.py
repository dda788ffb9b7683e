"""Panels: long tables (date, symbol, fields) made dense, aligned, resampled and reshaped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_end

KEYS = ["date", "symbol"]


def spine(dates: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each date and symbol; both sides are dimension tables."""
    return dates.select("date").distinct().crossJoin(symbols.select("symbol").distinct())


def dense(facts: DataFrame, dates: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """facts on the spine of the given (or its own) dates and symbols; missing cells are NULL."""
    return spine(facts if dates is None else dates, facts if symbols is None else symbols).join(facts, KEYS, "left")


def align(panel: DataFrame, dates: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """The panel on given dates, symbols or both: extra cells are dropped, new ones are NULL."""
    return dense(panel, dates, symbols)


def ones(dates: DataFrame, symbols: DataFrame, name: str = "value") -> DataFrame:
    return spine(dates, symbols).withColumn(name, F.lit(1.0))


def spread_series(series: DataFrame, symbols: DataFrame) -> DataFrame:
    """A (date, value) series repeated for each symbol."""
    return series.crossJoin(symbols.select("symbol").distinct())


def spread_row(row: DataFrame, dates: DataFrame) -> DataFrame:
    """A (symbol, value) row repeated for each date."""
    return dates.select("date").distinct().crossJoin(row)


def on_calendar(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    return rows.join(calendar.select("date").distinct(), "date", "left_semi")


def between(rows: DataFrame, start, end) -> DataFrame:
    return rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def month_last(panel: DataFrame, *fields: str) -> DataFrame:
    """Of each month and symbol, the last value that is there, at the month's end."""
    at = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("date"))).alias(f)
    return panel.groupBy(month_end(F.col("date")).alias("date"), "symbol").agg(*[at(f) for f in fields])


def downsample(panel: DataFrame, least_months: int = 2) -> DataFrame:
    """Monthly prices (last) and volume (sum); symbols with fewer months are dropped."""
    at = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("date"))).alias(f)
    monthly = panel.groupBy(month_end(F.col("date")).alias("date"), "symbol").agg(
        at("close"), at("adjusted_close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")
    )
    many = monthly.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= least_months)
    return monthly.join(many, "symbol", "left_semi")


def flatten(panel: DataFrame, mask: Column) -> DataFrame:
    return panel.filter(mask)


def pivoted(rows: DataFrame, value: str, symbols: list[str] | None = None) -> DataFrame:
    """Long to wide, a column for each symbol; a cell with two rows is an error."""
    only = F.when(F.count(F.lit(1)) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("two rows for a date and symbol")).cast("double"))
    return rows.groupBy("date").pivot("symbol", symbols).agg(only)


def unpivoted(wide: DataFrame, value: str = "value") -> DataFrame:
    return wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "symbol", value)


def zipped(*panels: DataFrame) -> DataFrame:
    """Panels side by side on their keys."""
    return reduce(lambda a, b: a.join(b, KEYS), panels)


def asof(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """The series' latest row at or before each calendar date; a missing value at its own date stays missing."""
    return asof_join(calendar.select("date").distinct(), series.select("date", "value"))


ASOF_DAYS = 366  # of a block of dates, in which rows are sorted


def asof_join(left: DataFrame, series: DataFrame, by: list[str] = (), at: str = "date", days: int = ASOF_DAYS, age: int | None = None) -> DataFrame:
    """left with the other columns of the latest row of series(by…, at, …) at or before its date, of the same keys.

    Each key's dates are cut into blocks of so many days. Rows are sorted inside their block only; the last row of
    each block is carried to those after it, over one row for each key and block. So the one key of a single series, or one
    that has most of all rows, is spread over as many tasks as it has blocks. A row that is there counts, whatever it
    holds; of several rows of a date the greatest counts. Keys that are null match null. With `age`, rows more than so many days
    older are not taken. Rows of left without a date, or without a row before them, get nulls.
    """
    by, values = list(by), [c for c in series.columns if c not in (*by, at)]
    if clash := set(values) & set(left.columns):
        raise ValueError(f"{sorted(clash)[0]!r} is on both sides")
    block = F.floor(F.unix_date(F.col(at).cast("date")) / days).alias("_block")
    found = series.filter(F.col(at).isNotNull()).select(*by, at, block, F.struct(F.col(at).alias("_at"), *values).alias("_row"))
    kind = found.schema["_row"].dataType
    asked = left.select(*by, at, block, F.lit(None).cast(kind).alias("_row"), F.struct(*left.columns).alias("_left"))
    both = found.withColumn("_left", F.lit(None).cast(asked.schema["_left"].dataType)).unionByName(asked)
    ends = found.groupBy(*by, "_block").agg(F.max("_row").alias("_last"))
    blocks = both.select(*by, "_block").distinct().alias("b").join(ends.alias("e"), _same([*by, "_block"], "b", "e"), "left").select("b.*", "_last")
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*by, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(at, F.col("_left").isNotNull(), "_row").rowsBetween(Window.unboundedPreceding, 0)
    latest = both.withColumn("_latest", F.last("_row", ignorenulls=True).over(inside)).filter("_left IS NOT NULL")
    met = latest.alias("l").join(carried.alias("c"), _same([*by, "_block"], "l", "c"), "left").withColumn("_found", F.coalesce("l._latest", "c._carried"))
    young = F.lit(True) if age is None else F.datediff(f"_left.{at}", "_found._at") <= age
    known = F.when(F.col(f"_left.{at}").isNotNull() & young, F.col("_found"))
    return met.select("_left", known.alias("_found")).select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def _same(names: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
