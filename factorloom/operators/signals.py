"""Volatility, trend signals, rates: features made of daily panels and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.ewma import ewma
from ..functions.scalar import floored, signal_response
from .panel import asof, asof_join, month_last

DAYS_PER_YEAR = 252
DAYS_PER_MONTH = 21
TREND_SPANS = ((8, 24), (16, 48), (32, 96))
SERIES = {"1m": "DGS1MO", "vix": "VIXCLS", "equity": "WILL5000IND"}


def realised_volatility(daily: DataFrame, price: str, window: int, fraction: float = 0.9, frequency: str = "m", least: int | None = None, name: str = "volatility") -> DataFrame:
    """Annualised deviation of daily log returns over `window` days; month-last for frequency m."""
    least = int(window * fraction) if least is None else least
    rows = daily.withColumn("_r", w.log_return(F.col(price)))
    rows = rows.withColumn(name, w.rolling_deviation(F.col("_r"), window, least, sample=True) * DAYS_PER_YEAR**0.5).drop("_r")
    if frequency == "b":
        return rows.select("date", "symbol", name)
    if frequency == "m":
        return month_last(rows, name)
    raise ValueError(f"unknown frequency {frequency!r}")


def future_volatility(daily: DataFrame, price: str, horizon: int, fraction: float = 0.9, frequency: str = "m", as_days: bool = True, name: str = "volatility") -> DataFrame:
    """Realised volatility of the next `horizon` periods; a monthly horizon spans 21 days a month."""
    window = horizon * DAYS_PER_MONTH if frequency == "m" and as_days else horizon
    rows = realised_volatility(daily, price, window, fraction, frequency, name=name)
    return rows.withColumn(name, w.shift(F.col(name), -horizon))


def volatility_forecast(daily: DataFrame, price: str, horizon: int, fraction: float = 0.9, frequency: str = "m", least: float = 0.01, model: str = "realized") -> DataFrame:
    """What has been realised lately, as the forecast of what is ahead."""
    if model != "realized":
        raise NotImplementedError(f"no volatility model {model!r}")
    days = DAYS_PER_MONTH * (3 if horizon < 6 else 2)
    rows = realised_volatility(daily, price, days, frequency=frequency, least=int(fraction * days))
    return rows.withColumn("volatility", floored(F.col("volatility"), least))


def trend_signals(daily: DataFrame, price: str, spans=TREND_SPANS, tolerance: float = 1e-4) -> DataFrame:
    """Month-last x, y, z and u of each pair of spans: mean gap, in price deviations, in its own, response."""
    rows = ewma(daily.select("date", "symbol", price), price, [n for pair in spans for n in pair])
    rows = rows.withColumn("_s", floored(w.rolling_deviation(F.col(price), 63, 60, sample=True), tolerance))
    names = []
    for j, (short, long) in enumerate(spans):
        rows = rows.withColumn(f"x{j}", F.col(f"{price}_ewma_{short}") - F.col(f"{price}_ewma_{long}"))
        rows = rows.withColumn(f"y{j}", F.try_divide(F.col(f"x{j}"), F.col("_s"))).withColumn(f"u{j}", signal_response(F.col(f"x{j}")))
        names += [f"{c}{j}" for c in "xyzu"]
    for j in range(len(spans)):
        own = floored(w.rolling_deviation(F.col(f"y{j}"), 252, 240, sample=True), tolerance)
        rows = rows.withColumn(f"z{j}", F.try_divide(F.col(f"y{j}"), own))
    return month_last(rows, *names)


def series_on(series: DataFrame, calendar: DataFrame, name: str = "1m") -> DataFrame:
    """One of the named series (rate by maturity, vix, equity) on a calendar, by its latest row."""
    if name not in SERIES:
        raise NotImplementedError(f"no series {name!r}")
    return asof(series.filter(F.col("series_id") == SERIES[name]).select("date", "value"), calendar)


def every_series_on(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """(series_id, date, value): all series of a table (series_id, date, value) on a calendar, each by its latest row."""
    asked = calendar.select("date").distinct().crossJoin(series.select("series_id").distinct())
    return asof_join(asked, series.select("series_id", "date", "value"), ["series_id"])


def risk_free_returns(rates: DataFrame) -> DataFrame:
    """Return of each date from the percentage rate of the date before, by days between."""
    order = Window.orderBy("date")
    days, rate = F.datediff("date", F.lag("date").over(order)), F.lag("value").over(order)
    return rates.select("date", (F.pow(1 + rate / 365 / 100, days) - 1).alias("value"))
