"""As-of joins, rolling intervals, mixed sample sets and one-pass summaries against brute force."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.calendar import is_period_end, offset
from factorloom.operators import backtest, dataset, panel, ratios
from factorloom.store import PanelStore, SampleSet

DAY = datetime.date(2020, 1, 1)


def dated(k):
    return DAY + datetime.timedelta(days=k)


@pytest.mark.parametrize("days", [1, 7, 5000])
def test_asof_join_equals_brute_force(spark, days):
    rng = random.Random(days)
    series = [("hot", dated(rng.randrange(900)), rng.choice([None, 1.0, 2.0]), k) for k in range(400)]
    series += [(rng.choice(["a", "b", None]), dated(rng.randrange(900)), float(k), k) for k in range(60)] + [("a", None, 5.0, 99)]
    left = [(rng.choice(["hot", "a", "b", None, "none"]), dated(rng.randrange(-50, 1000)), k) for k in range(300)] + [("a", None, 7), ("hot", dated(3), 8), ("hot", dated(3), 8)]
    sdf = spark.createDataFrame(series, "key string, date date, value double, n int").repartition(3)
    ldf = spark.createDataFrame(left, "key string, date date, id int").repartition(3)
    for age in (None, 30):
        found = sorted(map(str, panel.asof_join(ldf, sdf, ["key"], days=days, age=age).collect()))
        wanted = []
        for key, at, i in left:
            before = [(d, (v is not None, v or 0), n, v) for k, d, v, n in series if k == key and d and at and d <= at and (age is None or (at - d).days <= age)]
            best = max(before, key=lambda r: r[:3]) if before else (None, None, None, None)
            wanted.append(str(ldf.sparkSession and __import__("pyspark").sql.Row(key=key, date=at, id=i, value=best[3], n=best[2])))
        assert found == sorted(wanted)


def test_asof_join_of_one_series_and_of_nothing(spark):
    series = spark.createDataFrame([(dated(0), 1.0), (dated(400), None)], "date date, value double")
    days = spark.createDataFrame([(dated(k),) for k in (-1, 0, 399, 400, 2000)], "date date")
    assert {r.date: r.value for r in panel.asof(series, days).collect()} == {dated(-1): None, dated(0): 1.0, dated(399): 1.0, dated(400): None, dated(2000): None}
    assert [r.value for r in panel.asof(series.limit(0), days).collect()] == [None] * 5
    assert panel.asof(series, days.limit(0)).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        panel.asof_join(series, series)


@pytest.mark.parametrize("frequency, alias", [("d", "D"), ("b", "B"), ("w", "W"), ("m", "ME"), ("y", "YE")])
def test_periods_equal_pandas(spark, frequency, alias):
    days = spark.createDataFrame([(dated(k),) for k in range(800)], "date date")
    moves = {"d": pd.offsets.Day(), "b": pd.offsets.BusinessDay(), "w": pd.offsets.Week(), "m": pd.offsets.MonthEnd(), "y": pd.offsets.YearEnd()}[frequency]
    wanted = {x.date() for x in pd.date_range(dated(0), dated(799), freq=alias)}
    steps = (1, 3, -1, -4) if frequency in "dbw" else (1,)
    for r in days.select("date", is_period_end(F.col("date"), frequency).alias("end"), *[offset(F.col("date"), frequency, k).alias(f"at{k}") for k in steps]).collect():
        assert r["end"] == (r["date"] in wanted)
        for k in steps:
            assert r[f"at{k}"] == (pd.Timestamp(r["date"]) + k * moves).date()
    start, train, test = datetime.date(2019, 3, 4), datetime.date(2020, 2, 28), datetime.date(2020, 3, 7) if frequency in "dbw" else datetime.date(2021, 6, 1)
    for expanding in (True, False):
        ends = [e.date() for e in pd.date_range(train, pd.Timestamp(test) + moves, freq=alias)]
        got = dataset.rolling(spark, str(start), str(train), str(test), frequency, expanding).collect()
        assert {(r.fold, r.start, r.end) for r in got if r.split == "train"} == {(k, start if expanding else e - (train - start), e) for k, e in enumerate(ends)}
        assert {(r.fold, r.start, r.end) for r in got if r.split == "test"} == {(k, e, (pd.Timestamp(e) + moves).date()) for k, e in enumerate(ends)}
    with pytest.raises(NotImplementedError):
        offset(F.col("date"), "q")


def test_summaries_of_many_metrics_equal_each_alone(spark):
    rng = np.random.default_rng(2)
    months = pd.date_range("2018-01-31", periods=40, freq="ME")
    rows = [(m.date(), f"s{k:02d}", float(rng.uniform(5, 20)), *[float(v) if rng.random() > 0.1 else None for v in rng.normal(size=2)]) for m in months for k in range(30)]
    df = spark.createDataFrame(rows, "date date, symbol string, price double, a double, b double")
    both = backtest.metric_summaries(df, ["a", "b"], "price", [1, 3], n=3, least=4)
    assert both.count() == 4
    for metric in "ab":
        for window in (1, 3):
            wide = {c: pd.DataFrame([(r[0], r[1], r[i]) for r in rows], columns=["d", "s", "v"]).pivot(index="d", columns="s", values="v").astype(float) for c, i in (("price", 2), ("x", 3 if metric == "a" else 4))}
            ret = wide["price"].shift(-window) / wide["price"] - 1
            high, low, growth, dates, n_obs = [], [], np.ones(3), 0, 0
            for date in wide["x"].index:
                x, y = wide["x"].loc[date], ret.loc[date]
                ok = x.notna() & y.notna()
                if not ok.any():
                    continue
                edges = np.quantile(x[ok], [min(1.0, k * (1 / 3)) for k in range(4)])
                bucket = np.minimum((edges[None] <= x[ok].to_numpy()[:, None]).sum(1), 3)
                parts = [y[ok].to_numpy()[bucket == k] for k in (1, 2, 3)]
                low.extend(parts[0])
                high.extend(parts[2])
                if min(map(len, parts)) >= 4:
                    growth *= [(1 + p.mean()) ** (1 / window) for p in parts]
                    dates, n_obs = dates + 1, n_obs + ok.sum()
            (r,) = both.filter((F.col("metric") == metric) & (F.col("window") == window)).collect()
            year = growth ** (1 / (dates / 12)) - 1
            pooled = (np.var(high, ddof=1) * (len(high) - 1) + np.var(low, ddof=1) * (len(low) - 1)) / (len(high) + len(low) - 2)
            t = (np.mean(high) - np.mean(low)) / np.sqrt(pooled * (1 / len(high) + 1 / len(low)))
            assert (r.n_dates, r.n_obs) == (dates, n_obs)
            assert [r.low, r.high, r.alpha, r.overall_tstat] == pytest.approx([year[0], year[2], year[2] - year[0], t])
    assert backtest.metric_summaries(df.limit(0), ["a"], "price", [1]).count() == 0
    one = backtest.summary(df, "a", "price", [1], 3, 4)
    assert one.collect() == both.filter("metric = 'a' and window = 1").drop("metric").collect()
    scans = both._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans <= 4


def small_store(spark):
    days = spark.range(500).select(F.date_add(F.lit("2019-06-01").cast("date"), F.col("id").cast("int")).alias("date"))
    prices = days.crossJoin(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "symbol string, k double")).withColumns(
        {"close": F.lit(100.0), "adjusted_close": 100 + F.col("k") * F.sin(F.dayofyear("date").cast("double")), "volume": F.lit(5e6)}).drop("k")
    store = PanelStore(spark, "2019-06-01", days.filter(F.dayofweek("date").between(2, 6)), "2020-09-30")
    store.load(prices)
    return store


def test_panels_of_any_calendar_are_features(spark):
    store = small_store(spark)
    daily = store.volatility(21, "b")
    old = spark.createDataFrame([("a", "2020-03-31", 1.5), ("a", "2020-05-15", None), ("b", "2020-01-10", 2.5)], "symbol string, date string, value double").withColumn("date", F.to_date("date"))
    chosen = SampleSet(store, {"m3": F.col("adjusted_close") * 0 + 3}, 1, forecast="returns", age=40)
    chosen.add_feature_panel("old", old).add_features_from_dict({"vol": daily})
    cells = chosen.made(store.wide("m"))
    found = {(r.symbol, str(r.date)): r for r in cells.collect()}
    assert len(found) == 2 * 16 and {r.m3 for r in found.values()} == {3.0}
    assert [found["a", d].old for d in ("2020-02-29", "2020-03-31", "2020-04-30", "2020-05-31", "2020-06-30")] == [None, 1.5, 1.5, None, None]
    assert [found["b", d].old for d in ("2020-01-31", "2020-02-29")] == [2.5, None]  # 50 days are too old
    last = {(r.symbol, str(r.date)): r.value for r in daily.collect()}
    assert found["a", "2020-05-31"].vol == last["a", "2020-05-29"]  # a Sunday takes the Friday
    with pytest.raises(ValueError, match="no column"):
        chosen.add_feature_panel("odd", old.drop("value"))


def test_store_holds_caps_statements_and_ratios(spark):
    store = small_store(spark)
    with pytest.raises(LookupError):
        store.ratios()
    caps = spark.createDataFrame([("a", f"2019-{m:02d}-{d}", float(100 * m + d)) for m in (7, 8, 9) for d in (10, 20)] + [("b", "2019-07-10", 1.0), ("c", "2019-07-10", 1.0)],
                                 "symbol string, date string, market_cap double").withColumn("date", F.to_date("date"))
    panel_ = {(r.symbol, str(r.date)): r.value for r in store.load_market_caps(caps).collect()}
    assert len(panel_) == 32 and panel_["a", "2019-08-31"] == 820.0 and panel_["b", "2019-07-31"] is None  # one month is too few
    items = {c: [F.lit(10.0 if c != "netIncome" else 2.0)] for c in ratios.ITEMS}
    reports = spark.createDataFrame([(s, f"2019-{m:02d}-15") for s in "ac" for m in (3, 6, 7, 8, 9, 12)], "symbol string, report_date string").select(
        "symbol", F.to_date("report_date").alias("report_date"), *[v[0].alias(c) for c, v in items.items()])
    known = {(r.symbol, str(r.date)): r.netIncome for r in store.load_statements(reports).collect()}
    assert [known["a", d] for d in ("2019-06-30", "2019-07-31", "2019-10-31", "2020-01-31")] == [None, 2.0, 2.0, 2.0] and ("c", "2019-07-31") not in known
    found = {(r.symbol, str(r.date)): r.EarningsToPrice for r in store.ratios([ratios.Ratio.EARNINGS_TO_PRICE]).collect()}
    assert len(found) == 32 and found["a", "2019-09-30"] is None
    rate = spark.createDataFrame([("DGS1MO", "2019-06-03", 2.0), ("DGS1MO", "2030-01-01", 3.0)], "series_id string, date string, value double").withColumn("date", F.to_date("date"))
    assert {r.value for r in store.series(rate, "1m", "m").collect()} == {2.0}
    with pytest.raises(NotImplementedError):
        store.series(rate, "30y")
