"""Samples for learning: labels, intervals, folds, parameter grids."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.calendar import is_period_end, offset
from ..functions.scalar import ForecastType, floored
from .cross_section import rank_bucket
from .panel import KEYS
from .predicates import labelled
from .signals import future_volatility, volatility_forecast

INTERVALS = "fold int, split string, start date, end date"


def labels(panel: DataFrame, daily: DataFrame | None, price: str, horizon: int, kind: str = ForecastType.NORMALISED_RETURNS, n_buckets: int = 0, fraction: float = 0.9, frequency: str = "m", least: float = 0.01) -> DataFrame:
    """(date, symbol, y) on the dense panel: future volatility, its log, returns, or returns by forecast volatility.

    Buckets are ranks among all symbols of a date: filter by a mask only afterwards.
    """
    if kind in (ForecastType.VOLATILITY, ForecastType.LOG_VOLATILITY):
        found = future_volatility(daily, price, horizon, fraction, frequency)
        y = F.col("volatility") if kind == ForecastType.VOLATILITY else F.ln(floored(F.col("volatility"), least))
        return panel.select(*KEYS).join(found, KEYS, "left").select(*KEYS, y.alias("y"))
    if kind not in (ForecastType.RETURNS, ForecastType.NORMALISED_RETURNS):
        raise ValueError(f"unknown forecast type {kind!r}")
    rows = panel.select(*KEYS, w.future_return(F.col(price), horizon).alias("y"))
    if kind == ForecastType.NORMALISED_RETURNS:
        ahead = volatility_forecast(daily, price, horizon, fraction, frequency, least)
        rows = rows.join(ahead, KEYS, "left").select(*KEYS, F.try_divide("y", "volatility").alias("y"))
    return rows.withColumn("y", rank_bucket(F.col("y"), n_buckets)) if n_buckets else rows


def samples(features: DataFrame, y: DataFrame, mask: DataFrame, names: list[str], bucketed: bool = False, drop_missing: bool = False) -> DataFrame:
    """(timestamp, symbol, y, sorted features) of the good cells with a label."""
    rows = mask.filter("good").select(*KEYS).join(y, KEYS).join(features.select(*KEYS, *names), KEYS, "left")
    rows = labelled(rows, "y", names if drop_missing else (), bucketed)
    return rows.select(F.col("date").alias("timestamp"), "symbol", "y", *sorted(names))


@dataclass(frozen=True)
class Interval:
    """(start, end] of a split of a fold."""

    fold: int
    split: str
    start: date | None
    end: date | None


def by_period(spark: SparkSession, data_end: str, train_start: str, embargo: int = 12, valid: int = 36, test: int = 18) -> DataFrame:
    """Test, embargo, validation, embargo and training months, back from the end of the data."""
    back = lambda months: F.last_day(F.add_months(F.lit(data_end).cast("date"), -months))
    cuts = spark.range(1).select(
        F.lit(train_start).cast("date").alias("a"), back(test + embargo + valid + embargo).alias("b"), back(test + embargo + valid).alias("c"),
        back(test + embargo).alias("d"), back(test).alias("e"), F.lit(data_end).cast("date").alias("f"),
    )
    return cuts.select(F.inline(_intervals(F.lit(0), ("a", "b"), ("c", "d"), ("e", "f"))))


def custom(spark: SparkSession, train, validation, test) -> DataFrame:
    """Three explicit (start, end) pairs."""
    ends = [F.lit(str(x)).cast("date").alias(n) for n, x in zip("abcdef", (*train, *validation, *test), strict=True)]
    return spark.range(1).select(*ends).select(F.inline(_intervals(F.lit(0), ("a", "b"), ("c", "d"), ("e", "f"))))


def _intervals(fold: Column, *pairs) -> Column:
    names = ("train", "validation", "test")
    return F.array(*[F.struct(fold.cast("int").alias("fold"), F.lit(n).alias("split"), F.col(a).alias("start"), F.col(b).alias("end")) for n, (a, b) in zip(names, pairs, strict=True)])


def rolling(spark: SparkSession, start_train: str, end_train: str, end_test: str, frequency: str = "y", expanding: bool = True) -> DataFrame:
    """A fold for each period end (d, b, w, m or y) from end_train to a period after end_test; an empty validation, one period of test."""
    first, last = F.lit(end_train).cast("date"), offset(F.lit(end_test).cast("date"), frequency)
    begin = F.lit(start_train).cast("date")
    ends = F.filter(F.sequence(first, last, F.expr("interval 1 day")), lambda d: is_period_end(d, frequency))
    rows = spark.range(1).select(F.posexplode(ends).alias("fold", "e"))
    rows = rows.select("fold", "e", begin.alias("s") if expanding else F.date_sub(F.col("e"), F.datediff(first, begin)).alias("s"), offset(F.col("e"), frequency).alias("t"))
    return rows.select(F.inline(_intervals(F.col("fold"), ("s", "e"), ("e", "e"), ("e", "t"))))


def split(rows: DataFrame, intervals: DataFrame, at: str = "timestamp") -> DataFrame:
    """rows with (fold, split) for each interval that holds them; intervals are a few rows."""
    return rows.join(F.broadcast(intervals), (F.col(at) > F.col("start")) & (F.col(at) <= F.col("end"))).drop("start", "end")


def _edges(count: Column, n: int) -> list[Column]:
    return [F.floor(count * k / n) for k in range(1, n)]


def cv_groups(rows: DataFrame, n: int = 5, at: str = "timestamp", name: str = "group") -> DataFrame:
    """Groups 1..n of consecutive dates; a date at an edge belongs to the group before it."""
    times = rows.select(at).distinct()
    numbered = times.withColumn("_k", F.row_number().over(Window.orderBy(at)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    group = sum([F.when(F.col("_k") > e, 1).otherwise(0) for e in _edges(F.col("_n"), n)], F.lit(1))
    return rows.join(numbered.select(at, group.cast("int").alias(name)), at)


def cv_folds(rows: DataFrame, n: int = 5, at: str = "timestamp", name: str = "fold") -> DataFrame:
    """Folds 0..n-1 of consecutive dates; a date at an edge begins the next one."""
    times = rows.select(at).distinct()
    numbered = times.withColumn("_k", F.row_number().over(Window.orderBy(at)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    fold = sum([F.when(F.col("_k") >= e, 1).otherwise(0) for e in _edges(F.col("_n"), n)], F.lit(0))
    return rows.join(numbered.select(at, fold.cast("int").alias(name)), at)


def parameter_grid(options: dict[str, list]) -> list[dict]:
    """All combinations, the last key fastest."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]
