"""Golden arrays of rolling and fill operators, and pandas as the judge of random panels."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import windows as w
from factorloom.functions.ewma import ewma

N = None


def panel(spark, rows):
    cells = [(dt.date(2020, 1, 1) + dt.timedelta(i), "abc"[j], None if x is None else float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)]
    return spark.createDataFrame(cells, "date date, symbol string, x double")


def grid(df, name="y"):
    wide = df.select("date", "symbol", name).toPandas().pivot(index="date", columns="symbol", values=name).sort_index()
    return [[None if x is None or math.isnan(x) else round(x, 9) for x in r] for r in wide.to_numpy(float).tolist()]


# Inputs and results that must come out the same.
SUMS = [[0, 1, 2], [3, 5, 7], [9, 12, 15], [18, 22, 26], [30, 35, 40]]
GAP = [[0, 1, 2], [3, 5, N], [9, 12, 15], [18, 22, 26], [30, 35, 40]]


@pytest.mark.parametrize(("rows", "column", "expected"), [
    ([[1, 2, N], [3, N, 4], [N, N, 5], [6, 7, N], [8, N, N]], lambda x: w.fill_inside(x), [[1, 2, N], [3, 2, 4], [3, 2, 5], [6, 7, N], [8, N, N]]),
    (SUMS, lambda x: w.rolling_sum(x, 3), [[N] * 3, [N] * 3, [12, 18, 24], [30, 39, 48], [57, 69, 81]]),
    (GAP, lambda x: w.rolling_sum(x, 3, 2), [[N] * 3, [3, 6, N], [12, 18, 17], [30, 39, 41], [57, 69, 81]]),
    (GAP, lambda x: w.rolling_sum(x, 3, 1), [[0, 1, 2], [3, 6, 2], [12, 18, 17], [30, 39, 41], [57, 69, 81]]),
    (GAP, lambda x: w.rolling_sum(x, 3, 3), [[N] * 3, [N] * 3, [12, 18, N], [30, 39, N], [57, 69, 81]]),
    (SUMS, lambda x: w.rolling_mean(x, 3), [[N] * 3, [N] * 3, [4, 6, 8], [10, 13, 16], [19, 23, 27]]),
    ([[0, 1, 2], [3, N, 7], [9, 12, 15], [18, 22, 26], [30, 35, N]], lambda x: w.rolling_mean(x, 3, 2), [[N] * 3, [1.5, N, 4.5], [4, 6.5, 8], [10, 17, 16], [19, 23, 20.5]]),
])
def test_golden(spark, rows, column, expected):
    assert grid(panel(spark, rows).withColumn("y", column(F.col("x")))) == [[None if x is None else float(x) for x in r] for r in expected]


def test_population_deviation(spark):
    rows = [[0, 1, 2], [3, 5, N], [9, 12, 15], [18, 22, 26], [30, 35, 40], [32, 13, 24]]
    found = grid(panel(spark, rows).withColumn("y", w.rolling_deviation(F.col("x"), 3, 2)))
    values = np.array([[np.nan if x is None else x for x in r] for r in rows], float)
    for i in range(len(rows)):
        for j in range(3):
            part = values[max(0, i - 2) : i + 1, j]
            expected = np.nanstd(part) if (~np.isnan(part)).sum() >= 2 else None
            assert found[i][j] is None if expected is None else abs(found[i][j] - expected) < 1e-8


@pytest.mark.parametrize("n", [8, 96])
def test_ewma_is_pandas(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(700) < 0.1, np.nan, rng.normal(100, 5, 700))
    x[:3] = np.nan
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), "a", None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = ewma(spark.createDataFrame(rows, "date date, symbol string, x double"), "x", [n]).orderBy("date").toPandas()
    pd.testing.assert_series_equal(df[f"x_ewma_{n}"].astype(float), pd.Series(x).ewm(alpha=1 / n).mean(), check_names=False, rtol=1e-9)


def test_momentum_needs_a_lag_below_the_window(spark):
    with pytest.raises(ValueError):
        w.momentum(F.col("x"), 3, 3)
