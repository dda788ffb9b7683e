"""Column expressions of the panel algebra. Missing values are NULL, never NaN."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class ReturnType(StrEnum):
    ARITHMETIC = "arith"
    LOG = "log"


class ForecastType(StrEnum):
    VOLATILITY = "volatility"
    LOG_VOLATILITY = "log_vol"
    RETURNS = "returns"
    NORMALISED_RETURNS = "norm_returns"


class SplitName(StrEnum):
    TRAIN = "train"
    VALIDATION = "validation"
    TEST = "test"


class Direction(StrEnum):
    BULL = "bull"
    BEAR = "bear"


def clean(x: Column) -> Column:
    """A double without NaN."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def floored(x: Column, least: float) -> Column:
    """max(x, least) that keeps NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(least))))


def clipped(x: Column, low: float = float("-inf"), high: float = float("inf")) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def gain(now: Column, before: Column, kind: str = ReturnType.ARITHMETIC) -> Column:
    """Return from before to now, arithmetic or logarithmic."""
    ratio = F.try_divide(now, before)
    if kind == ReturnType.ARITHMETIC:
        return ratio - 1
    if kind == ReturnType.LOG:
        return F.ln(ratio)
    raise ValueError(f"unknown return type {kind!r}")


def null_near_zero(x: Column, tolerance: float = 1e-8) -> Column:
    return F.when(F.abs(x) > tolerance, x)


def reversed_labels(y: Column, n: int) -> Column:
    """Relevance labels 0..n-1 in the opposite order."""
    return F.lit(n - 1) - y


def normalised_momentum(momentum: Column, volatility: Column, least: float = 0.03) -> Column:
    return F.try_divide(momentum, floored(volatility, least))


def day_gap(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def signal_response(x: Column) -> Column:
    """x exp(-x^2/4) / 0.89: grows, peaks and fades."""
    return x * F.exp(-F.pow(x, 2) / 4) / 0.89
