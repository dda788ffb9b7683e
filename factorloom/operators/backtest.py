"""Backtests of metric buckets: mean returns, t-statistics, growth, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.calendar import PERIODS_PER_YEAR
from ..functions.scalar import clipped, normalised_momentum
from ..sources.shared import kept
from .cross_section import quantile_bucket


def valid_pairs(panel: DataFrame, metric: str, ret: str, good: Column | None = None, clip=(float("-inf"), float("inf"))) -> DataFrame:
    """(date, symbol, metric, ret) of the cells that have both and are good."""
    rows = panel.select("date", "symbol", F.col(metric).alias("metric"), clipped(F.col(ret), *clip).alias("ret"), (F.lit(True) if good is None else good).alias("_good"))
    return rows.filter("metric IS NOT NULL AND ret IS NOT NULL AND _good").drop("_good")


def bucket_means(pairs: DataFrame, dates: DataFrame, n: int) -> DataFrame:
    """(date, bucket, mean_ret, n_obs) for each date and bucket; empty buckets have no mean and 0."""
    placed = quantile_bucket(pairs, "metric", n).groupBy("date", "bucket").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n_obs"))
    cells = dates.select("date").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return cells.join(placed, ["date", "bucket"], "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)).cast("long"))


def _t(high: str = "h", low: str = "l") -> Column:
    """Student's t of two samples with pooled variance, from means, variances and counts."""
    n1, n2 = F.col(f"{high}_n"), F.col(f"{low}_n")
    squares = F.coalesce(F.col(f"{high}_v"), F.lit(0.0)) * (n1 - 1) + F.coalesce(F.col(f"{low}_v"), F.lit(0.0)) * (n2 - 1)
    pooled = F.try_divide(squares, n1 + n2 - 2)
    return F.try_divide(F.col(f"{high}_m") - F.col(f"{low}_m"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))


def tstats(pairs: DataFrame, n: int, by: Column | None = None, least_low: int = 0) -> DataFrame:
    """t-statistic of the returns of bucket n against bucket 1, over all dates or by a column (key)."""
    placed = quantile_bucket(pairs, "metric", n).withColumn("key", F.lit("all") if by is None else by)
    of = lambda b, p: [f(F.when(F.col("bucket") == b, F.col("ret"))).alias(f"{p}_{a}") for f, a in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))]
    sums = placed.groupBy("key").agg(*of(n, "h"), *of(1, "l"))
    enough = (F.col("h_n") > 0) & (F.col("l_n") > 0) & (F.col("l_n") > least_low)
    return sums.select("key", F.when(enough, _t()).alias("tstat"))


def performance(means: DataFrame, window: int, least: int) -> DataFrame:
    """Growth of each bucket over the dates whose buckets all have `least` values, per-period returns compounded."""
    full = F.min("n_obs").over(Window.partitionBy("date"))
    whole = means.withColumn("_least", full).filter(F.col("_least") >= least).drop("_least")
    period = F.pow(1 + F.col("mean_ret"), F.lit(1.0 / window)) - 1
    along = Window.partitionBy("bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return whole.withColumn("growth", w.growth(period, along))


SETS = ["metric", "window"]


def bucket_cells(panel: DataFrame, metrics, price: str, windows, n: int = 5, good: Column | None = None, clip=(float("-inf"), float("inf"))) -> DataFrame:
    """(metric, window, date, bucket, n_obs, total, squares) of every metric and return window, in one pass over the panel.

    Metrics and windows become rows; the quantiles of a metric, window and date and the sums of its buckets share one
    shuffle. Sums of returns and of their squares are all that the summaries need, and can be added over dates."""
    returns = {window: F.col(f"_r{k}") for k, window in enumerate(windows)}
    wide = panel.withColumns({f"_r{k}": clipped(w.future_return(F.col(price), window), *clip) for k, window in enumerate(windows)})
    wide = wide.filter(F.lit(True) if good is None else good)
    both = F.array(*[F.struct(F.lit(str(m)).alias("metric"), F.col(str(m)).cast("double").alias("x")) for m in metrics])
    ahead = F.array(*[F.struct(F.lit(window).alias("window"), ret.alias("ret")) for window, ret in returns.items()])
    rows = wide.select("date", F.explode(both).alias("m"), ahead.alias("ahead")).filter("m.x IS NOT NULL")
    rows = rows.select("date", "m.*", F.explode("ahead").alias("a")).select("date", "metric", "x", "a.*").filter("ret IS NOT NULL")
    shares = ", ".join(f"{min(1.0, k * (1 / n))!r}D" for k in range(n + 1))
    edges = F.expr(f"percentile(x, array({shares}))").over(Window.partitionBy(*SETS, "date"))
    placed = rows.withColumn("_edges", edges).withColumn("bucket", F.least(F.size(F.filter("_edges", lambda e: e <= F.col("x"))), F.lit(n)))
    return placed.groupBy(*SETS, "date", "bucket").agg(F.count("*").alias("n_obs"), F.sum("ret").alias("total"), F.sum(F.col("ret") * F.col("ret")).alias("squares"))


def _cell_tstats(cells: DataFrame, n: int, by: list[str], least_low: int = 0) -> DataFrame:
    """t-statistic of bucket n against bucket 1 from sums of cells."""
    of = lambda b, p: [F.sum(F.when(F.col("bucket") == b, F.col(c))).alias(f"{p}_{c}") for c in ("n_obs", "total", "squares")]
    sums = cells.groupBy(*by).agg(*of(n, "h"), *of(1, "l"))
    for p in "hl":
        count, total = F.coalesce(F.col(f"{p}_n_obs"), F.lit(0)), F.col(f"{p}_total")
        mean = F.try_divide(total, count)
        spread = F.when(count > 1, F.greatest(F.lit(0.0), (F.col(f"{p}_squares") - mean * total) / (count - 1)))
        sums = sums.withColumns({f"{p}_n": count, f"{p}_m": mean, f"{p}_v": spread})
    return sums.select(*by, F.when((F.col("h_n") > 0) & (F.col("l_n") > least_low), _t()).alias("tstat"))


def metric_summaries(panel: DataFrame, metrics, price: str, return_windows, n: int = 5, least: int = 10, good: Column | None = None, clip=(float("-inf"), float("inf")), frequency: str = "m") -> DataFrame:
    """A row for each metric and return window: low, high, alpha, t-statistics and counts. No dates, no row.

    Dates count whose buckets all have `least` values, one at least. The cells of all metrics are written once."""
    cells = kept(bucket_cells(panel, metrics, price, return_windows, n, good, clip), "cells")
    dates = Window.partitionBy(*SETS, "date")
    full = (F.count("*").over(dates) == n) & (F.min("n_obs").over(dates) >= max(1, least))
    growth = F.product(F.pow(1 + F.col("total") / F.col("n_obs"), F.lit(1.0) / F.col("window")))
    ends = cells.withColumn("_full", full).filter("_full").groupBy(*SETS, "bucket").agg(
        growth.alias("last"), F.count("*").alias("n_dates"), F.sum("n_obs").alias("n_obs"), F.min("n_obs").alias("min_obs")
    ).withColumn("year", F.pow("last", F.lit(1.0) / (F.col("n_dates") / F.lit(float(PERIODS_PER_YEAR[frequency])))) - 1)
    line = ends.groupBy(*SETS).agg(
        F.max(F.when(F.col("bucket") == 1, F.col("year"))).alias("low"), F.max(F.when(F.col("bucket") == n, F.col("year"))).alias("high"),
        F.sum("n_obs").alias("n_obs"), F.min("min_obs").alias("min_obs"), F.max("n_dates").alias("n_dates"),
    ).withColumn("alpha", F.col("high") - F.col("low"))
    overall = _cell_tstats(cells, n, SETS).withColumnRenamed("tstat", "overall_tstat")
    years = _cell_tstats(cells.withColumn("year", F.year("date")), n, [*SETS, "year"], 3).groupBy(*SETS).agg(F.expr("percentile(tstat, array(0.25, 0.5, 0.75))").alias("q"))
    found = line.join(overall, SETS, "left").join(years, SETS, "left")
    quarters = [F.col("q")[k].alias(f"tstat_{share}") for k, share in enumerate((25, 50, 75))]
    return found.select("low", "high", "n_obs", "min_obs", "n_dates", "alpha", "overall_tstat", *quarters, "window", "metric")


def summary(panel: DataFrame, metric: str, price: str, windows, n: int = 5, least: int = 10, **options) -> DataFrame:
    """The summaries of one metric."""
    return metric_summaries(panel, [metric], price, windows, n, least, **options).drop("metric")


def momentum_summaries(panel: DataFrame, price: str, momentum_windows, return_windows, lags=(), **options) -> DataFrame:
    """Summaries of momentum over several windows and lags (0 always among them, each under its window)."""
    made = {f"mom_{span}m" + (f"{lag}" if lag else ""): w.momentum(F.col(price), span, lag) for span in momentum_windows for lag in sorted({0, *lags}) if lag < span}
    return metric_summaries(panel.withColumns(made), list(made), price, return_windows, **options)


__all__ = ["bucket_cells", "bucket_means", "metric_summaries", "momentum_summaries", "normalised_momentum", "performance", "summary", "tstats", "valid_pairs"]
