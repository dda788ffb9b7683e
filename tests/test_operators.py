"""Edges of cross-section, cleaning, catalogue, splits and portfolios."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions.calendar import month_ends_ahead
from factorloom.operators import cross_section as xs
from factorloom.operators import dataset, panel, scoring
from factorloom.operators.cleaning import without_spikes
from factorloom.operators.ratios import with_ratios
from factorloom.operators.trimming import trimmed
from factorloom.plans import research_queries
from factorloom.sources.catalog import Catalog
from factorloom.sources.tables import prices


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def test_rank_buckets(spark):
    rows = [(day(0), s, x) for s, x in zip("abcde", (1.0, 1.0, None, 5.0, 9.0), strict=True)] + [(day(1), "a", 3.0)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double").withColumn("b", xs.rank_bucket(F.col("x"), 3)).withColumn("p", xs.percentile_rank(F.col("x")))
    found = {(r.date, r.symbol): (r.b, r.p) for r in df.collect()}
    assert [found[day(0), s][0] for s in "abcde"] == [0, 1, -1, 2, 2]
    assert found[day(0), "c"][1] is None and found[day(1), "a"] == (2, None)


def test_quantile_buckets_hold_the_top(spark):
    df = spark.createDataFrame([(day(0), str(k), float(k)) for k in range(11)], "date date, symbol string, x double")
    found = {int(r.symbol): r.bucket for r in xs.quantile_bucket(df, "x", 5).collect()}
    edges = np.quantile(np.arange(11.0), np.linspace(0, 1, 6))
    edges[-1] += 0.01
    assert found == {k: int(np.digitize(k, edges)) for k in range(11)}


def test_spikes_go_until_none_is_left(spark):
    prices = [10, 10, 2, 10, 10, 30, 10, 10, 25, 3, 11, 10]
    df = spark.createDataFrame([(day(k), "a", float(p), 1.0) for k, p in enumerate(prices)] + [(day(99), "a", 5.0, 0.0)], "date date, symbol string, adjusted_close double, volume double")
    left = list(enumerate(map(float, prices)))
    while True:
        gone = set()
        for i in range(1, len(left) - 1):
            b, x, a = left[i - 1][1], left[i][1], left[i + 1][1]
            if (x / b < 0.5 and a / x > 1.9 or x / b > 1.9 and a / x < 0.5) and b > 1 and a > 1:
                gone.add(i)
        if not gone:
            break
        left = [v for i, v in enumerate(left) if i not in gone]
    assert sorted(r.date for r in without_spikes(df).collect()) == [day(k) for k, _ in left]


def test_month_ends(spark):
    rows = [("2020-01-31", 1, "2020-02-29"), ("2020-01-30", 1, "2020-01-31"), ("2020-01-31", -1, "2019-12-31"), ("2020-01-15", 0, "2020-01-31"), ("2020-01-15", -1, "2019-12-31")]
    df = spark.createDataFrame(rows, "d string, k int, e string")
    assert all(str(r.m) == r.e for r in df.select("e", month_ends_ahead(F.col("d").cast("date"), F.col("k")).alias("m")).collect())


def test_pivot_refuses_two_rows_of_a_cell(spark):
    df = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "a", 2.0)], "date date, symbol string, x double")
    with pytest.raises(Exception, match="two rows"):
        panel.pivoted(df, "x", ["a"]).collect()


def test_catalogue_versions(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/panels")
    assert catalog.metadata().count() == 0 and catalog.load("x") is None
    df = spark.createDataFrame([(day(0), "a", 1.0), (day(1), "b", 2.0)], "date date, symbol string, value double")
    assert [catalog.save(df, "x", "b"), catalog.save(df, "x", "b", data_source="made"), catalog.save(df, "y", "b")] == [0, 1, 0]
    assert catalog.metadata().filter("datatype = 'x'").count() == 2
    assert catalog.load("x", data_source="made").count() == 2 and catalog.load("x", 0).count() == 2
    with pytest.raises(ValueError):
        catalog.load("x", 7)
    with pytest.raises(ValueError):
        catalog.save(df, "x", "b", "csv")


def test_rolling_intervals_end_a_period_after_the_last(spark):
    rows = dataset.rolling(spark, "2010-12-31", "2015-06-30", "2018-12-31").filter("split = 'test'").orderBy("fold").collect()
    assert [str(r.start) for r in rows] == [f"{y}-12-31" for y in range(2015, 2020)]


def test_solvers():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 6))
    cov = a.T @ a / 30
    least, risk = scoring.least_variance(cov, 0.4), scoring.equal_risk(cov)
    assert abs(least.sum() - 1) < 1e-6 and least.max() <= 0.4 + 1e-6 and least @ cov @ least <= cov.mean() + 1e-9
    shares = risk * (cov @ risk)
    assert abs(risk.sum() - 1) < 1e-6 and shares.std() / shares.mean() < 0.2
    assert np.linalg.eigvalsh(scoring.nearest_covariance(np.array([[1, 0.99, -0.99], [0.99, 1, 0.99], [-0.99, 0.99, 1]])))[0] > 0


def test_trimming_keeps_k(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("d", float(a), float(b)) for a, b in rng.normal(size=(200, 2))], "day string, a double, b double")
    assert 50 <= trimmed(rows, ["day"], "a", "b", 0.1, 50).filter("left").count() < 200


def test_unknown_ratio(spark):
    with pytest.raises(ValueError):
        with_ratios(spark.createDataFrame([], "date date, symbol string"), ["nothing"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_grid_and_folds_fit_rankers_and_average_forward_returns(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(research_queries, "cross_validated", lambda model, rows, returns, **cv: calls.append((model, rows, returns, cv)))
    monkeypatch.setattr(research_queries, "grid_search", lambda make, rows, options, returns, path, **cv: calls.append((make(**{k: v[0] for k, v in options.items()}), rows, returns, cv)))
    research_queries.cross_validation(spark, "/root/testdata/sf0.001")
    research_queries.grid(spark, "/root/testdata/sf0.001")
    daily = prices(spark, "/root/testdata/sf0.001", "p_brand", False).toPandas().pivot(index="date", columns="symbol", values="adjusted_close").ffill()
    monthly = daily.groupby(lambda d: (d.year, d.month)).last()
    ahead = (monthly.shift(-1) / monthly - 1).stack().to_dict()
    for model, rows, returns, cv in calls:
        assert isinstance(model, research_queries.BoostedRanker) and model.options.get("n_estimators", 100) >= 80 and cv.get("n_folds", 5) == 5
        found = rows.collect()
        assert found and all(r[returns] == pytest.approx(ahead[(r.timestamp.year, r.timestamp.month), r.symbol]) and r.y in (0, 1, 2) for r in found)
    assert len(calls) == 2 and len(list(research_queries.dataset.parameter_grid(research_queries.GRID))) == 81
