"""Filters as boolean columns on a dense panel, and the default filter sets.

A missing value fails a filter unless it says otherwise; no filter is ever NULL. A filter reads a
field, which must be a column of the panel: `with_masks` adds fields made of windows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.scalar import clean, gain

Predicate = Callable[[Column], Column]


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def equal_to(value) -> Predicate:
    return lambda x: _sure(x == value)


def in_range(low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = True) -> Predicate:
    def test(x: Column) -> Column:
        above = F.lit(True) if low is None else (x >= low if low_inclusive else x > low)
        below = F.lit(True) if high is None else (x <= high if high_inclusive else x < high)
        return _sure(above & below & x.isNotNull())

    return test


def whole_column_in_range(low=None, high=None, ignore_missing: bool = True, **bounds) -> Predicate:
    """A symbol passes if all its dates do."""
    inside = in_range(low, high, **bounds)
    return lambda x: F.bool_and(inside(x) | (x.isNull() & F.lit(ignore_missing))).over(w.whole_symbol())


def whole_row_in_range(low=None, high=None, ignore_missing: bool = True, **bounds) -> Predicate:
    """A date passes if all its symbols do."""
    inside = in_range(low, high, **bounds)
    return lambda x: F.bool_and(inside(x) | (x.isNull() & F.lit(ignore_missing))).over(w.by_date())


def not_missing(x: Column) -> Column:
    return x.isNotNull()


def missing(x: Column) -> Column:
    return x.isNull()


@dataclass(frozen=True)
class Rule:
    """A predicate on a property of the panel: a field, or columns made of it, step by step."""

    steps: tuple[Callable[[Column], Column], ...]
    test: Predicate
    source: str

    def mask(self, panel: DataFrame, name: str) -> DataFrame:
        panel = panel.withColumn(name, F.col(self.source))
        for step in (*self.steps, self.test):
            panel = panel.withColumn(name, step(F.col(name)))
        return panel


@dataclass(frozen=True)
class Rules:
    """An immutable list of rules; adding to it gives another."""

    rules: tuple[Rule, ...] = ()

    def add(self, source: str, test: Predicate, *steps) -> Rules:
        return Rules((*self.rules, Rule(tuple(steps), test, source)))

    def good(self, panel: DataFrame, name: str = "good") -> DataFrame:
        """The panel with the conjunction of all rules."""
        names = [f"_rule{k}" for k in range(len(self.rules))]
        for rule, each in zip(self.rules, names, strict=True):
            panel = rule.mask(panel, each)
        return panel.withColumn(name, reduce(Column.__and__, [F.col(n) for n in names], F.lit(True))).drop(*names)


@dataclass(frozen=True)
class Thresholds:
    min_obs: int = 10
    min_price: float = 1.0
    min_volume: float = 21 * 10_000.0
    max_return: float = 10.0
    max_missing_days: int = 3
    days: int = 63
    extra: dict = field(default_factory=dict)


def monthly_rules(at: Thresholds = Thresholds()) -> Rules:
    """The nine monthly filters; the panel needs close, adjusted_close, volume and missing_days."""
    return (
        Rules()
        .add("close", not_missing)
        .add("adjusted_close", not_missing)
        .add("adjusted_close", not_missing, lambda x: w.rolling_mean(x, 12))
        .add("missing_days", in_range(None, at.max_missing_days))
        .add("volume", not_missing)
        .add("close", in_range(at.min_price), lambda x: w.rolling_min(x, 3, 1))
        .add("adjusted_close", in_range(at.min_price), lambda x: w.rolling_min(x, 3, 1))
        .add("volume", in_range(at.min_volume), lambda x: w.rolling_low_quantile(x, 12, 0.01))
        .add("adjusted_close", whole_column_in_range(None, at.max_return), lambda x: gain(x, w.shift(x, 1)))
    )


def daily_rules(at: Thresholds = Thresholds()) -> Rules:
    """The four daily filters on adjusted_close; changes are taken over filled prices."""
    return (
        Rules()
        .add("adjusted_close", not_missing)
        .add("adjusted_close", in_range(at.min_price))
        .add("adjusted_close", in_range(at.min_price), lambda x: w.rolling_min(x, at.days, 1))
        .add("adjusted_close", in_range(None, at.max_return), w.fill_forward, lambda x: gain(x, w.shift(x, 1)))
    )


def labelled(rows: DataFrame, label: str, features: Iterable[str] = (), bucketed: bool = False) -> DataFrame:
    """Rows with a label (not negative, if bucketed) and, where named, all features."""
    y = clean(F.col(label))
    rows = rows.filter(y >= 0 if bucketed else y.isNotNull())
    return rows.dropna(subset=list(features)) if features else rows
