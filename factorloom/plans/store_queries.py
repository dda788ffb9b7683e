"""The store of panels and its samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.scalar import ForecastType
from ..operators import dataset
from ..operators.predicates import Thresholds
from ..sources.catalog import Catalog
from ..sources.shared import new_path
from ..operators.ratios import Ratio
from ..sources.tables import daily_facts, market_caps, nation_facts, rates, statements
from ..store import PanelStore, SampleSet
from .base import BY, PD, RATES, RAW_D, RAW_N, STATEMENTS, fut, lag, mom, r6, register, rolling
from .feature_queries import CTA, RATIOS, RATIO_SQL, vol_sql
from .panel_queries import SPIKES

START, END = "1995-03-01", "2001-06-30"
AT = Thresholds(min_price=1000.0, min_volume=1500.0, max_return=4.5, max_missing_days=14)
A = "adjusted_close"


def weekdays(spark, d):
    days = daily_facts(spark, d).select("date").distinct()
    return days.filter(F.dayofweek("date").between(2, 6))


def loaded(spark, d, catalog: Catalog | None = None) -> PanelStore:
    store = PanelStore(spark, START, weekdays(spark, d), END, catalog)
    store.load(daily_facts(spark, d))
    return store


def _long(panels):
    found = None
    for name, rows in panels.items():
        part = rows.select(F.lit(name).alias("datatype"), "date", "symbol", "value")
        found = part if found is None else found.unionByName(part)
    return found


STORE = f"""all_days AS (SELECT * FROM ({{raw}})), raw AS (SELECT * FROM all_days WHERE date BETWEEN DATE '{START}' AND DATE '{END}'), {SPIKES},
days AS (SELECT DISTINCT date FROM raw WHERE dayofweek(date) BETWEEN 1 AND 5),
ends AS (SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', DATE '{START}'), DATE '{END}', INTERVAL 1 MONTH)) AS m)),
dl AS (SELECT s6.* FROM s6 SEMI JOIN days USING (date)),
syms AS (SELECT symbol FROM dl GROUP BY 1 HAVING count({A}) >= 252),
mo AS (SELECT last_day(date) AS date, symbol, arg_max(close, date) AS close, arg_max({A}, date) AS {A}, sum(volume) AS volume FROM s6 GROUP BY 1, 2),
ml AS (SELECT * FROM mo WHERE symbol IN (SELECT symbol FROM mo GROUP BY 1 HAVING count(*) >= 2)),
pd AS (SELECT days.date, syms.symbol, dl.{A}, dl.volume FROM days CROSS JOIN syms LEFT JOIN dl ON dl.date = days.date AND dl.symbol = syms.symbol),
pm AS (SELECT ends.date, syms.symbol, ml.close, ml.{A}, coalesce(ml.volume, 0) AS volume FROM ends CROSS JOIN syms LEFT JOIN ml ON ml.date = ends.date AND ml.symbol = syms.symbol)"""
STORE_N = STORE.format(raw=RAW_N.removeprefix("raw AS (").removesuffix(")"))
STORE = STORE.format(raw=RAW_D.removeprefix("raw AS (").removesuffix(")"))
LONG = f"""SELECT 'daily_prices' AS datatype, date, symbol, {A} AS value FROM pd UNION ALL SELECT 'daily_volume', date, symbol, volume FROM pd
UNION ALL SELECT 'adjusted_close', date, symbol, {A} FROM pm UNION ALL SELECT 'close', date, symbol, close FROM pm UNION ALL SELECT 'volume', date, symbol, volume FROM pm"""


@register("load_prices", f"WITH {STORE} SELECT datatype, date, symbol, {r6('value')} FROM ({LONG})")
def load_prices(spark, d):
    return _long(loaded(spark, d).panels)


@register("load_saved_panel", f"WITH {STORE} SELECT datatype, date, symbol, {r6('value')} FROM ({LONG})")
def load_saved_panel(spark, d):
    catalog = Catalog(spark, new_path(spark, "panels"))
    loaded(spark, d, catalog).save()
    return _long(PanelStore(spark, START, weekdays(spark, d), END, catalog).load_saved())


SET = f"""{STORE}, g AS (SELECT last_day(date) AS date, symbol, arg_max(k, date) AS missing_days FROM (
  SELECT date, symbol, CASE WHEN count(*) OVER m >= 63 THEN count(*) OVER m - count({A}) OVER m END AS k FROM pd WINDOW m AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)) WHERE k IS NOT NULL GROUP BY 1, 2),
w AS (SELECT pm.*, missing_days, {rolling(A, 12, None, 'avg')} AS full12, {rolling('close', 3, 1, 'min')} AS c3, {rolling(A, 3, 1, 'min')} AS a3, {rolling('volume', 12, None, 'min')} AS v12,
  {A} / {lag(A, 1)} - 1 AS ret, {mom(A, 3)} AS m3, {mom(A, 6)} AS m6, {fut(A, 1)} AS y FROM pm LEFT JOIN g USING (date, symbol)),
good AS (SELECT *, close IS NOT NULL AND {A} IS NOT NULL AND full12 IS NOT NULL AND coalesce(missing_days <= 14, false) AND volume IS NOT NULL AND coalesce(c3 >= 1000, false)
  AND coalesce(a3 >= 1000, false) AND coalesce(v12 >= 1500, false) AND bool_and(ret IS NULL OR ret <= 4.5) OVER (PARTITION BY symbol) AS good FROM w)"""


@register("dataset_samples", f"""WITH {SET}, iv AS (SELECT * FROM (VALUES ('train', DATE '1995-03-31', DATE '1998-12-31'), ('validation', DATE '1999-01-31', DATE '1999-12-31'), ('test', DATE '2000-01-31', DATE '2001-05-31')) AS v(split, a, b))
SELECT CAST(0 AS INTEGER) AS fold, split, date AS "timestamp", symbol, {r6('y', 'm3', 'm6')} FROM good JOIN iv ON date > a AND date <= b WHERE good AND y IS NOT NULL AND m3 IS NOT NULL AND m6 IS NOT NULL""")
def dataset_samples(spark, d):
    intervals = dataset.custom(spark, ("1995-03-31", "1998-12-31"), ("1999-01-31", "1999-12-31"), ("2000-01-31", "2001-05-31"))
    features = {"m3": w.momentum(F.col(A), 3), "m6": w.momentum(F.col(A), 6)}
    chosen = SampleSet(loaded(spark, d), features, 1, forecast=ForecastType.RETURNS, drop_missing=True, at=AT, intervals=intervals)
    return chosen.groups().select("fold", "split", "timestamp", "symbol", "y", "m3", "m6")


def nation_store(spark, d) -> PanelStore:
    """A store of symbols that have prices, market caps and statements."""
    days = nation_facts(spark, d).select("date").distinct().filter(F.dayofweek("date").between(2, 6))
    store = PanelStore(spark, START, days, END)
    store.load(nation_facts(spark, d))
    store.load_market_caps(market_caps(spark, d))
    store.load_statements(statements(spark, d))
    return store


#: The store's statements and ratios: reports of its range, on its month ends and symbols.
KNOWN = STATEMENTS.replace("FROM sums)", f"FROM sums WHERE report_date BETWEEN DATE '{START}' AND DATE '{END}')").partition("months AS")[0]
ITEMS_N = f"""{STORE_N}, {KNOWN} mcap AS (SELECT * FROM caps WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
p AS (SELECT m.date, s.symbol, known.* EXCLUDE (date, symbol), market_cap FROM ends m CROSS JOIN syms s
  LEFT JOIN known ON known.date = m.date AND known.symbol = s.symbol
  LEFT JOIN (SELECT * FROM mcap WHERE symbol IN (SELECT symbol FROM mcap GROUP BY 1 HAVING count(*) > 2)) mc ON mc.date = m.date AND mc.symbol = s.symbol)"""
RATIOS_N = f"{ITEMS_N}{RATIOS.removeprefix(STATEMENTS)}"
_CHOSEN = (Ratio.ROA, Ratio.EARNINGS_TO_PRICE, Ratio.ASSET_GROWTH)


@register("store_ratios", f"WITH {RATIOS_N} SELECT date, symbol, {r6('market_cap', 'totalRevenue')}, {', '.join(f'round({RATIO_SQL[n]} + 1e-9, 6) + 0.0 AS {n.value}' for n in _CHOSEN)} FROM filled")
def store_ratios(spark, d):
    """Market caps, statements and ratios, all from the store."""
    store = nation_store(spark, d)
    caps = store.panels["market_cap"].withColumnRenamed("value", "market_cap")
    items = store.load_statements(statements(spark, d)).select("date", "symbol", "totalRevenue")
    return caps.join(items, ["date", "symbol"]).join(store.ratios(_CHOSEN), ["date", "symbol"])


@register("store_series", f"""WITH {RATES}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) SELECT days.date, {r6('value')} FROM days ASOF LEFT JOIN rates ON days.date >= rates.date""")
def store_series(spark, d):
    from ..sources.tables import table

    days = table(spark, d, "events").select(F.to_date("ts").alias("date")).distinct()
    return PanelStore(spark, "2023-12-01", days, "2024-12-31").series(rates(spark, d), "1m", "b")


_TREND = CTA.removeprefix(f"WITH {PD}, ").replace("FROM p)", "FROM tp)")
MIXED = f"""{RATIOS_N}, rated AS (SELECT date, symbol, {RATIO_SQL[Ratio.ROA]} AS roa FROM filled),
{vol_sql(63, 10).replace("FROM p)", "FROM pd)")}, tp AS (SELECT date, symbol, {A} FROM pd), trend AS (SELECT * FROM ({{trend}})),
g AS (SELECT last_day(date) AS date, symbol, arg_max(k, date) AS missing_days FROM (
  SELECT date, symbol, CASE WHEN count(*) OVER m >= 63 THEN count(*) OVER m - count({A}) OVER m END AS k FROM pd WINDOW m AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)) WHERE k IS NOT NULL GROUP BY 1, 2),
w AS (SELECT pm.*, missing_days, {rolling(A, 12, None, 'avg')} AS full12, {rolling('close', 3, 1, 'min')} AS c3, {rolling(A, 3, 1, 'min')} AS a3, {rolling('volume', 12, None, 'min')} AS v12,
  {A} / {lag(A, 1)} - 1 AS ret, {mom(A, 3)} AS m3, {fut(A, 1)} AS y FROM pm LEFT JOIN g USING (date, symbol)),
good AS (SELECT *, close IS NOT NULL AND {A} IS NOT NULL AND full12 IS NOT NULL AND coalesce(missing_days <= 50, false) AND volume IS NOT NULL AND coalesce(c3 >= 1000, false)
  AND coalesce(a3 >= 1000, false) AND coalesce(v12 >= 100, false) AND bool_and(ret IS NULL OR ret <= 4.5) OVER (PARTITION BY symbol) AS good FROM w)"""


@register("dataset_mixed_features", f"""WITH {MIXED.replace("{trend}", "WITH " + _TREND.rpartition("SELECT last_day(date) AS date")[0] + " SELECT last_day(date) AS date, symbol, arg_max(x0, date) AS x0 FROM z GROUP BY 1, 2")}
SELECT good.date AS "timestamp", good.symbol, round(good.y + 1e-9, 6) + 0.0 AS y, {r6('m3', 'roa', 'volatility')}, round(trend.x0 + 1e-9, 6) + 0.0 AS trend
FROM good LEFT JOIN rated ON rated.date = good.date AND rated.symbol = good.symbol LEFT JOIN trend ON trend.date = good.date AND trend.symbol = good.symbol
ASOF LEFT JOIN (SELECT date, symbol, v AS volatility FROM v) vo ON vo.symbol = good.symbol AND good.date >= vo.date WHERE good AND good.y IS NOT NULL""")
def dataset_mixed_features(spark, d):
    """Samples with a momentum column, a ratio by months, a volatility by days and a trend signal, placed as of each month end."""
    store = nation_store(spark, d)
    chosen = SampleSet(store, {"m3": w.momentum(F.col(A), 3)}, 1, forecast=ForecastType.RETURNS, at=MIXED_AT)
    chosen.add_feature_panel("roa", store.ratios([Ratio.ROA]).withColumnRenamed("ROA", "value"))
    chosen.add_features_from_dict({"volatility": store.volatility(63, "b", least=10), "trend": store.trend()["x0"]})
    return chosen.frame()


MIXED_AT = Thresholds(min_price=1000.0, min_volume=100.0, max_return=4.5, max_missing_days=50)
