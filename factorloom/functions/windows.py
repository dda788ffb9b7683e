"""Window expressions along dates (per symbol) and across symbols (per date).

Frames count rows, so tables must be dense: a row for each date and symbol (operators.panel.dense).
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .scalar import ReturnType, floored, gain



def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def whole_symbol() -> WindowSpec:
    return Window.partitionBy("symbol")


def last_rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def shift(x: Column, n: int) -> Column:
    """The value n rows ago; ahead for negative n."""
    return F.lag(x, n).over(by_symbol()) if n >= 0 else F.lead(x, -n).over(by_symbol())


def fill_forward(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def fill_inside(x: Column, date: str = "date") -> Column:
    """Fills gaps between values; what follows the last value stays missing."""
    last = F.max(F.when(x.isNotNull(), F.col(date))).over(whole_symbol())
    return F.when(F.col(date) <= last, fill_forward(x))


def _enough(x: Column, n: int, least: int | None) -> Column:
    return F.count(x).over(last_rows(n)) >= (n if least is None else least)


def rolling_sum(x: Column, n: int, least: int | None = None, fill: bool = True) -> Column:
    """Sum of the last n rows with `least` values; without fill also missing where x itself is."""
    found = F.when(_enough(x, n, least), F.sum(x).over(last_rows(n)))
    return found if fill else F.when(x.isNotNull(), found)


def rolling_mean(x: Column, n: int, least: int | None = None) -> Column:
    return F.when(_enough(x, n, least), F.avg(x).over(last_rows(n)))


def rolling_deviation(x: Column, n: int, least: int | None = None, sample: bool = False) -> Column:
    """Standard deviation of the last n rows; of the population unless sample."""
    return F.when(_enough(x, n, least), (F.stddev_samp if sample else F.stddev_pop)(x).over(last_rows(n)))


def rolling_min(x: Column, n: int, least: int | None = None) -> Column:
    return F.when(_enough(x, n, least), F.min(x).over(last_rows(n)))


def rolling_missing(x: Column, n: int) -> Column:
    """How many of the last n rows are missing, once there are n rows."""
    rows = F.count(F.lit(1)).over(last_rows(n))
    return F.when(rows >= n, rows - F.count(x).over(last_rows(n)))


def rolling_low_quantile(x: Column, n: int, q: float) -> Column:
    """The lower q-quantile of n values; for q under 1/(n-1) this is their minimum."""
    if q * (n - 1) < 1:
        return rolling_min(x, n)
    values = F.sort_array(F.collect_list(x).over(last_rows(n)))
    return F.when(_enough(x, n, None), F.element_at(values, int(q * (n - 1)) + 1))


def rolling_return(x: Column, n: int, kind: str = ReturnType.ARITHMETIC, tolerance: float = 1e-6) -> Column:
    """Return over n rows; give fill_inside(x), from a step before, to bridge gaps."""
    return gain(x, shift(x, n) + tolerance, kind)


def future_return(x: Column, n: int, kind: str = ReturnType.ARITHMETIC, least: float = 1e-4) -> Column:
    return gain(floored(shift(x, -n), least), floored(x, least), kind)


def momentum(x: Column, n: int, lag: int = 0, kind: str = ReturnType.LOG, least: float = 1e-4) -> Column:
    if not 0 <= lag < n:
        raise ValueError("the lag must be at least 0 and less than the window")
    return gain(floored(shift(x, lag), least), floored(shift(x, n), least), kind)


def log_return(x: Column, least: float = 1e-4) -> Column:
    """One-row log return; missing where a price or the one before is about zero."""
    real = (F.abs(x) > 1e-8) & (F.abs(shift(x, 1)) > 1e-8)
    return F.when(real, gain(floored(x, least), floored(shift(x, 1), least), ReturnType.LOG))


def growth(r: Column, window: WindowSpec | None = None) -> Column:
    """Cumulated growth of returns."""
    return F.product(1 + r).over(so_far() if window is None else window)
