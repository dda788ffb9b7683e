"""A store of price panels, and samples for learning from them: what a research script starts with."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import windows as w
from .functions.calendar import month_calendar
from .functions.scalar import ForecastType, normalised_momentum
from .operators import cleaning, dataset, panel, ratios, signals
from .operators.predicates import Rules, Thresholds, daily_rules, monthly_rules
from .sources.catalog import Catalog, check_dates
from .sources.shared import kept

#: The price panels, the calendar of each and the daily or monthly field that it holds.
PANELS = {
    "daily_prices": ("b", "adjusted_close"), "daily_volume": ("b", "volume"), "adjusted_close": ("m", "adjusted_close"),
    "close": ("m", "close"), "volume": ("m", "volume"),
}


@dataclass
class PanelStore:
    """Panels over the business days and month ends from start to end (the last month end before today, if empty).

    `business_days` is a table of the exchange's days (date). Panels come from a table of daily prices by
    `load`, or as they were saved to the catalogue by `load_saved`; either is done once. Symbols are
    those with 252 daily prices, unless empty ones are to stay.
    """

    spark: SparkSession
    start: str
    business_days: DataFrame
    end: str = ""
    catalog: Catalog | None = None
    symbols: DataFrame | None = None
    drop_empty: bool = True
    panels: dict[str, DataFrame] = field(default_factory=dict)
    items: DataFrame | None = None

    def __post_init__(self):
        if not self.end:
            self.end = str(datetime.date.today().replace(day=1) - datetime.timedelta(days=1))
        days = panel.between(self.business_days.select("date").distinct(), self.start, self.end)
        months = panel.between(month_calendar(self.spark, self.start, self.end).select("date"), self.start, self.end)
        self.calendars = {"b": days, "m": months}

    def load(self, prices: DataFrame) -> dict[str, DataFrame]:
        """The panels (date, symbol, value) of prices(symbol, date, close, adjusted_close, volume): in range, without
        spikes, the daily ones placed on business days, the monthly ones downsampled (two months at least)
        and placed on month ends. Cells without a value are NULL, but 0 in the monthly volume."""
        if self.panels:
            return self.panels
        rows = panel.between(prices, self.start, self.end)
        if self.symbols is not None:
            rows = rows.join(self.symbols.select("symbol").distinct(), "symbol", "left_semi")
        clean = cleaning.without_spikes(rows)
        daily = kept(panel.on_calendar(clean, self.calendars["b"]), "daily")
        symbols = (rows if self.symbols is None else self.symbols).select("symbol").distinct()
        if self.drop_empty:
            symbols = cleaning.with_history(daily, "adjusted_close").select("symbol").distinct()
        symbols = kept(symbols, "symbols")
        monthly = kept(panel.on_calendar(panel.downsample(clean), self.calendars["m"]), "monthly")
        facts = {"b": daily, "m": monthly}
        for name, (calendar, source) in PANELS.items():
            value = facts[calendar].select("date", "symbol", F.col(source).cast("double").alias("value"))
            found = panel.align(value, self.calendars[calendar], symbols)
            self.panels[name] = found.withColumn("value", F.coalesce("value", F.lit(0.0))) if name == "volume" else found
        self.symbols = symbols
        return self.panels

    def save(self) -> dict[str, int]:
        """Saves the loaded panels to the catalogue; their versions."""
        return self.catalog.save_prices({name: (self.panels[name], calendar) for name, (calendar, _) in PANELS.items()})

    def load_saved(self) -> dict[str, DataFrame]:
        """The latest saved panels, on the symbols of the daily prices and in range; the dates must be the calendar's."""
        if self.panels:
            return self.panels
        found = {name: self.catalog.load(name, start=self.start, end=self.end) for name in PANELS}
        if missing := [name for name, rows in found.items() if rows is None]:
            raise LookupError(f"no saved panel of {missing[0]}")
        self.symbols = found["daily_prices"].select("symbol").distinct()
        for name, (calendar, _) in PANELS.items():
            rows = check_dates(panel.between(found[name], self.start, self.end), self.calendars[calendar])
            self.panels[name] = rows.join(self.symbols, "symbol", "left_semi").select("date", "symbol", "value")
        return self.panels

    def wide(self, calendar: str) -> DataFrame:
        """(date, symbol, fields) of the panels of a calendar side by side."""
        named = [self.panels[name].withColumnRenamed("value", source) for name, (c, source) in PANELS.items() if c == calendar]
        return panel.zipped(*named)


    def load_market_caps(self, caps: DataFrame, least_months: int = 3) -> DataFrame:
        """The panel `market_cap` of caps(symbol, date, market_cap): the month's last value of symbols with so many months in
        range, on the store's month ends and symbols."""
        if ratios.MARKET_CAP not in self.panels:
            monthly = panel.month_last(panel.between(caps, self.start, self.end), ratios.MARKET_CAP)
            many = monthly.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= least_months)
            found = monthly.join(many, "symbol", "left_semi").select("date", "symbol", F.col(ratios.MARKET_CAP).cast("double").alias("value"))
            self.panels[ratios.MARKET_CAP] = kept(panel.align(found, self.calendars["m"], self.symbols), ratios.MARKET_CAP)
        return self.panels[ratios.MARKET_CAP]

    def load_statements(self, statements: DataFrame, delay: int = 1) -> DataFrame:
        """The statements (symbol, report_date, items) of the store's range on its month ends and symbols, known `delay` months later."""
        if self.items is None:
            inside = statements.filter(F.col("report_date").between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date")))
            known = inside.join(self.symbols.select("symbol"), "symbol", "left_semi")
            self.items = kept(ratios.reported(known, self.calendars["m"], self.symbols, delay), "items")
        return self.items

    def series(self, table: DataFrame, name: str = "1m", calendar: str = "b") -> DataFrame:
        """(date, value) of one of the named series (rate by maturity, vix, equity) on a calendar, by its latest row."""
        return signals.series_on(panel.between(table, self.start, self.end), self.calendars[calendar], name)

    def ratios(self, names=tuple(ratios.Ratio), **options) -> DataFrame:
        """(date, symbol, ratios) of the statements and market caps that were loaded."""
        if self.items is None or ratios.MARKET_CAP not in self.panels:
            raise LookupError("load statements and market caps first")
        caps = self.panels[ratios.MARKET_CAP].withColumnRenamed("value", ratios.MARKET_CAP)
        return ratios.with_ratios(self.items.join(caps, panel.KEYS, "left"), names, **options).select(*panel.KEYS, *map(str, names))

    def momentum(self, window: int, lag: int = 0, normalised: bool = False) -> DataFrame:
        """(date, symbol, value): momentum over so many months, over the volatility of as many (21 days each, 19 with a price) if normalised."""
        rows = self.panels["adjusted_close"].select(*panel.KEYS, w.momentum(F.col("value"), window, lag).alias("value"))
        if not normalised:
            return rows
        vol = self.volatility(window * 21, least=window * 19)
        return rows.join(vol.withColumnRenamed("value", "_vol"), panel.KEYS, "left").select(*panel.KEYS, normalised_momentum(F.col("value"), F.col("_vol")).alias("value"))

    def volatility(self, window: int, frequency: str = "m", **options) -> DataFrame:
        """(date, symbol, value): realised volatility over so many days, daily or at month ends."""
        return signals.realised_volatility(self.wide("b"), "adjusted_close", window, frequency=frequency, name="value", **options)

    def trend(self) -> dict[str, DataFrame]:
        """Panels of the trend signals by name, at month ends."""
        rows = kept(signals.trend_signals(self.wide("b"), "adjusted_close"), "trend")
        return {c: rows.select(*panel.KEYS, F.col(c).alias("value")) for c in rows.columns if c not in panel.KEYS}


@dataclass
class SampleSet:
    """Samples of a store's panels: features, label, filters and intervals in one place.

    A feature is a column of the monthly (or daily) fields of the store, or any panel (date, symbol, value): each cell of the samples
    takes the panel's latest row of its symbol at or before its date, at most `age` days old; a value that is missing
    there stays missing.
    """

    store: PanelStore
    features: dict
    horizon: int = 1
    frequency: str = "m"
    forecast: str = ForecastType.NORMALISED_RETURNS
    n_buckets: int = 0
    fraction: float = 0.9
    drop_missing: bool = False
    at: Thresholds = field(default_factory=Thresholds)
    intervals: DataFrame | None = None
    rules: Rules | None = None
    age: int = 31

    def __post_init__(self):
        if self.rules is None:
            self.rules = monthly_rules(self.at) if self.frequency == "m" else daily_rules(self.at)

    def add_feature_panel(self, name: str, values: DataFrame) -> SampleSet:
        """Adds a panel (date, symbol, value) of any calendar as a feature."""
        if missing := {"date", "symbol", "value"} - set(values.columns):
            raise ValueError(f"no column {sorted(missing)[0]!r} in the panel of {name!r}")
        self.features = {**self.features, name: values}
        return self

    def add_features_from_dict(self, panels: dict) -> SampleSet:
        for name, values in panels.items():
            self.add_feature_panel(name, values)
        return self

    def made(self, rows: DataFrame) -> DataFrame:
        """(date, symbol, features) of the cells of rows: all panels are placed by one as-of join."""
        columns = {n: f for n, f in self.features.items() if not isinstance(f, DataFrame)}
        panels = {n: f for n, f in self.features.items() if isinstance(f, DataFrame)}
        found = rows.select(*panel.KEYS, *[column.alias(name) for name, column in columns.items()])
        if not panels:
            return found
        marked = [f.select("date", "symbol", F.lit(n).alias("feature"), F.col("value").cast("double").alias("value")) for n, f in panels.items()]
        series = reduce(DataFrame.unionByName, marked)
        asked = rows.select(*panel.KEYS, F.explode(F.array(*[F.lit(n) for n in panels])).alias("feature"))
        placed = panel.asof_join(asked, series, ["symbol", "feature"], age=self.age)
        wide = placed.groupBy(*panel.KEYS).agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in panels])
        return found.join(wide, panel.KEYS, "left")

    def base(self) -> DataFrame:
        """The panel that features, label and filters read."""
        if self.frequency != "m":
            return self.store.wide("b")
        daily = self.store.wide("b").withColumn("missing_days", w.rolling_missing(F.col("adjusted_close"), self.at.days))
        return self.store.wide("m").join(panel.month_last(daily, "missing_days"), panel.KEYS, "left")

    def frame(self) -> DataFrame:
        """(timestamp, symbol, y, sorted features) of all good samples."""
        rows = kept(self.rules.good(self.base()), "good")
        made = self.made(rows)
        y = dataset.labels(rows, self.store.wide("b"), "adjusted_close", self.horizon, self.forecast, self.n_buckets, self.fraction, self.frequency)
        return dataset.samples(made, y, rows, list(self.features), bucketed=self.n_buckets > 0, drop_missing=self.drop_missing)

    def groups(self) -> DataFrame:
        """The samples of each fold's training, validation and test intervals (fold, split)."""
        if self.intervals is None:
            raise ValueError("no intervals")
        return dataset.split(self.frame(), self.intervals)
