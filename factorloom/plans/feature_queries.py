"""Windows along dates, signals, rates and accounting ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.ewma import ewma
from ..functions.scalar import ReturnType, day_gap, normalised_momentum, null_near_zero, signal_response
from ..operators import signals
from ..operators.panel import asof, asof_join
from ..operators.ratios import Ratio, reported, with_ratios
from ..sources.tables import market_cap_panel, market_caps, nation_facts, panel_d, panel_m, rates, statements, table
from .base import BY, PD, PM, RATES, RAW_N, STATEMENTS, floor, fut, lag, logret, mom, r6, register, rolling, rows

A = "adjusted_close"


def _windows(name: str, base: str, columns: dict):
    """A query of window columns: name -> (SQL, Column)."""
    cte, source = {"m": (PM, panel_m), "d": (PD, panel_d)}[base]
    inner = ", ".join(f"{sql} AS {n}" for n, (sql, _) in columns.items())

    @register(name, f"WITH {cte}, q AS (SELECT date, symbol, {inner} FROM p) SELECT date, symbol, {r6(*columns)} FROM q")
    def query(spark, d):
        return source(spark, d).select("date", "symbol", *[c().cast("double").alias(n) for n, (_, c) in columns.items()])




def X():
    return F.col(A)


INSIDE = f"CASE WHEN date <= max(CASE WHEN {{x}} IS NOT NULL THEN date END) OVER (PARTITION BY symbol) THEN last_value({{x}} IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) END"
_windows("shift_lag_lead", "m", {"back": (lag(A, 2), lambda: w.shift(X(), 2)), "ahead": (lag(A, -3), lambda: w.shift(X(), -3))})
_windows("begin_period_lag", "m", {"begin": (lag(A, 12), lambda: w.shift(X(), 12))})
_windows("ffill_interior", "d", {"filled": (INSIDE.format(x=A), lambda: w.fill_inside(X()))})
_windows("ffill_full", "d", {"filled": (f"last_value({A} IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING)", lambda: w.fill_forward(X()))})
_windows("rolling_sum_min_obs", "d", {"s": (rolling(A, 5, 2), lambda: w.rolling_sum(X(), 5, 2)), "whole": (rolling(A, 5), lambda: w.rolling_sum(X(), 5))})
_windows("rolling_sum_nofill", "d", {"s": (f"CASE WHEN {A} IS NOT NULL THEN {rolling(A, 5, 2)} END", lambda: w.rolling_sum(X(), 5, 2, fill=False))})
_windows("rolling_mean", "d", {"m": (rolling(A, 10, 3, "avg"), lambda: w.rolling_mean(X(), 10, 3))})
_windows("rolling_std_pop", "d", {"s": (rolling(A, 10, 3, "stddev_pop"), lambda: w.rolling_deviation(X(), 10, 3))})
_windows("rolling_std_sample", "d", {"s": (rolling(A, 10, 3, "stddev_samp"), lambda: w.rolling_deviation(X(), 10, 3, sample=True))})
_windows("rolling_min", "d", {"m": (rolling(A, 63, 1, "min"), lambda: w.rolling_min(X(), 63, 1))})
_windows("rolling_null_count", "d", {"k": (f"CASE WHEN count(*) {rows(63)} >= 63 THEN count(*) {rows(63)} - count({A}) {rows(63)} END", lambda: w.rolling_missing(X(), 63))})
_windows("rolling_q01_lower", "m", {"q": (rolling("volume", 12, None, "min"), lambda: w.rolling_low_quantile(F.col("volume"), 12, 0.01))})
_windows("rolling_return_arith", "m", {"r": (f"{A} / ({lag(A, 6)} + 1e-6) - 1", lambda: w.rolling_return(X(), 6))})
_windows("rolling_return_log", "m", {"r": (f"ln({A} / ({lag(A, 6)} + 1e-6))", lambda: w.rolling_return(X(), 6, ReturnType.LOG))})
_windows("future_return", "m", {"f1": (fut(A, 1), lambda: w.future_return(X(), 1)), "f6": (fut(A, 6), lambda: w.future_return(X(), 6))})
_windows("future_return_log", "m", {"f1": (f"ln(1 + ({fut(A, 1)}))", lambda: w.future_return(X(), 1, ReturnType.LOG))})
_windows("momentum", "m", {"m3": (mom(A, 3), lambda: w.momentum(X(), 3)), "m12": (mom(A, 12), lambda: w.momentum(X(), 12))})
_windows("momentum_lagged", "m", {"m": (mom(A, 12, 1), lambda: w.momentum(X(), 12, 1))})
_windows("log_returns", "d", {"r": (logret(A), lambda: w.log_return(X()))})
_windows("scalar_math", "m", {
    "near": ("CASE WHEN abs(close - 1500) > 1e-8 THEN close - 1500 END", lambda: null_near_zero(F.col("close") - 1500)),
    "response": ("(close / 1000) * exp(-pow(close / 1000, 2) / 4) / 0.89", lambda: signal_response(F.col("close") / 1000)),
    "norm": ("(close / 1000) / greatest(volume / 10000, 0.03)", lambda: normalised_momentum(F.col("close") / 1000, F.when(X().isNotNull(), F.col("volume") / 10000))),
    "days": (f"date - lag(date) OVER ({BY})", lambda: day_gap(F.col("date"), w.shift(F.col("date"), 1))),
})


@register("cumprod_growth", f"""WITH {PM}, f AS (SELECT date, symbol, {fut(A, 1)} AS r FROM p),
m AS (SELECT date, avg(r) AS r FROM f WHERE r IS NOT NULL GROUP BY 1)
SELECT date, round(product(1 + r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) + 1e-9, 6) + 0.0 AS growth FROM m""")
def cumprod_growth(spark, d):
    from pyspark.sql import Window

    r = panel_m(spark, d).select("date", w.future_return(X(), 1).alias("r")).filter("r IS NOT NULL").groupBy("date").agg(F.avg("r").alias("r"))
    return r.select("date", w.growth(F.col("r"), Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("growth"))


def ewma_sql(n: int) -> str:
    """One span by its definition: weights by age, over all rows so far."""
    q = repr(1 - 1 / n) + "::DOUBLE"
    return f"""e{n} AS (SELECT a.symbol, a.i, sum(b.x * pow({q}, a.i - b.i)) FILTER (WHERE b.x IS NOT NULL) / nullif(sum(pow({q}, a.i - b.i)) FILTER (WHERE b.x IS NOT NULL), 0) AS e{n}
  FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i AND a.i - b.i <= {40 * n} GROUP BY 1, 2)"""


NUMBERED = f"{PD}, n AS (SELECT date, symbol, {A} AS x, row_number() OVER ({BY}) - 1 AS i FROM p)"


def _ewma(n: int):
    @register(f"ewma_span{n}", f"WITH {NUMBERED}, {ewma_sql(n)} SELECT date, n.symbol, round(e{n} + 1e-9, 6) + 0.0 AS ewma FROM n JOIN e{n} USING (symbol, i)")
    def query(spark, d):
        return ewma(panel_d(spark, d), A, [n]).select("date", "symbol", F.col(f"{A}_ewma_{n}").alias("ewma"))


for _n in (8, 16, 24, 32, 48, 96):
    _ewma(_n)

_XYZU = [f"{c}{j}" for j in range(3) for c in "xyzu"]
_s = floor(rolling("x", 63, 60, "stddev_samp"), 1e-4)
CTA = f"""WITH {NUMBERED}, {', '.join(ewma_sql(n) for n in (8, 24, 16, 48, 32, 96))},
j AS (SELECT n.*, e8, e24, e16, e48, e32, e96 FROM n {' '.join(f'JOIN e{n} USING (symbol, i)' for n in (8, 24, 16, 48, 32, 96))}),
s AS (SELECT *, {_s} AS s, e8 - e24 AS x0, e16 - e48 AS x1, e32 - e96 AS x2 FROM j),
y AS (SELECT *, x0 / s AS y0, x1 / s AS y1, x2 / s AS y2, {', '.join(f'x{k} * exp(-pow(x{k}, 2) / 4) / 0.89 AS u{k}' for k in range(3))} FROM s),
z AS (SELECT *, {', '.join(f'y{k} / ({floor(rolling(f"y{k}", 252, 240, "stddev_samp"), 1e-4)}) AS z{k}' for k in range(3))} FROM y)
SELECT last_day(date) AS date, symbol, {', '.join(f'round(arg_max({c}, date) + 1e-9, 6) + 0.0 AS {c}' for c in _XYZU)} FROM z GROUP BY 1, 2"""


@register("cta_signals", CTA)
def cta_signals(spark, d):
    return signals.trend_signals(panel_d(spark, d), A).select("date", "symbol", *_XYZU)


def vol_sql(window: int, least: int) -> str:
    return f"r AS (SELECT date, symbol, {logret(A)} AS r FROM p), v AS (SELECT date, symbol, ({rolling('r', window, least, 'stddev_samp')}) * sqrt(252) AS v FROM r)"


MONTHLY_VOL = "mv AS (SELECT last_day(date) AS date, symbol, arg_max(v, date) AS volatility FROM v GROUP BY 1, 2)"


@register("realized_vol_daily", f"WITH {PD}, {vol_sql(63, 56)} SELECT date, symbol, round(v + 1e-9, 6) + 0.0 AS volatility FROM v")
def realized_vol_daily(spark, d):
    return signals.realised_volatility(panel_d(spark, d), A, 63, 0.9, "b")


@register("realized_vol_monthly", f"WITH {PD}, {vol_sql(63, 56)}, {MONTHLY_VOL} SELECT date, symbol, {r6('volatility')} FROM mv")
def realized_vol_monthly(spark, d):
    return signals.realised_volatility(panel_d(spark, d), A, 63)


FUTURE_VOL = f"{PD}, {vol_sql(63, 56)}, {MONTHLY_VOL}, fv AS (SELECT date, symbol, lead(volatility, 3) OVER ({BY}) AS volatility FROM mv)"


@register("future_vol", f"WITH {FUTURE_VOL} SELECT date, symbol, {r6('volatility')} FROM fv")
def future_vol(spark, d):
    return signals.future_volatility(panel_d(spark, d), A, 3)


@register("vol_forecast", f"WITH {PD}, {vol_sql(63, 56)}, {MONTHLY_VOL} SELECT date, symbol, round(CASE WHEN volatility IS NOT NULL THEN greatest(volatility, 0.01) END + 1e-9, 6) + 0.0 AS volatility FROM mv")
def vol_forecast(spark, d):
    return signals.volatility_forecast(panel_d(spark, d), A, 1)


@register("vol_forecast_long", f"WITH {PD}, {vol_sql(42, 37)}, {MONTHLY_VOL} SELECT date, symbol, round(CASE WHEN volatility IS NOT NULL THEN greatest(volatility, 0.01) END + 1e-9, 6) + 0.0 AS volatility FROM mv")
def vol_forecast_long(spark, d):
    return signals.volatility_forecast(panel_d(spark, d), A, 12)


DAYS = "days AS (SELECT CAST(x AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) - 2 FROM events), (SELECT max(CAST(ts AS DATE)) + 3 FROM events), INTERVAL 1 DAY)) AS x))"


def _days(spark, d):
    """All days from two before the first event to three after the last."""
    ends = table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return ends.select(F.explode(F.sequence(F.date_sub("a", 2), F.date_add("b", 3))).alias("date"))


@register("asof_rate", f"WITH {RATES}, {DAYS} SELECT days.date, {r6('value')} FROM days ASOF LEFT JOIN rates ON days.date >= rates.date")
def asof_rate(spark, d):
    return signals.series_on(rates(spark, d), _days(spark, d))


@register("asof_keeps_missing", f"""WITH {RATES}, {DAYS}, gappy AS (SELECT date, CASE WHEN day(date) % 2 = 0 THEN value END AS value FROM rates)
SELECT days.date, {r6('value')} FROM days ASOF LEFT JOIN gappy ON days.date >= gappy.date""")
def asof_keeps_missing(spark, d):
    some = rates(spark, d).withColumn("value", F.when(F.dayofmonth("date") % 2 == 0, F.col("value")))
    return asof(some, _days(spark, d))


@register("asof_users", f"""WITH {DAYS}, seen AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2),
asked AS (SELECT date, user_id FROM days CROSS JOIN (SELECT DISTINCT user_id FROM events))
SELECT asked.date, asked.user_id, {r6('value')}, n FROM asked ASOF LEFT JOIN seen ON asked.user_id = seen.user_id AND asked.date >= seen.date""")
def asof_users(spark, d):
    """Each user's latest day with events, on every day: as many series as users."""
    events = table(spark, d, "events")
    seen = events.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    asked = _days(spark, d).crossJoin(events.select("user_id").distinct())
    return asof_join(asked, seen, ["user_id"], days=7)


@register("asof_prices", f"""WITH {STATEMENTS}, {RAW_N} SELECT caps.date, caps.symbol, round(market_cap + 1e-9, 6) + 0.0 AS market_cap, round(adjusted_close + 1e-9, 6) + 0.0 AS price
FROM caps ASOF LEFT JOIN raw ON caps.symbol = raw.symbol AND caps.date >= raw.date""")
def asof_prices(spark, d):
    """The latest daily price of each symbol at every month end that has a market cap."""
    daily = nation_facts(spark, d).select("date", "symbol", F.col(A).alias("price"))
    return asof_join(market_caps(spark, d), daily, ["symbol"])


@register("series_on_calendar", f"""WITH {DAYS}, kinds AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, round(avg(value) + 1e-9, 6) AS value FROM events GROUP BY 1, 2),
asked AS (SELECT date, series_id FROM days CROSS JOIN (SELECT DISTINCT series_id FROM kinds))
SELECT asked.date, asked.series_id, {r6('value')} FROM asked ASOF LEFT JOIN kinds ON asked.series_id = kinds.series_id AND asked.date >= kinds.date""")
def series_on_calendar(spark, d):
    kinds = table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value") + 1e-9, 6).alias("value"))
    return signals.every_series_on(kinds, _days(spark, d))


@register("risk_free_return", f"WITH {RATES} SELECT date, round(pow(1 + lag(value) OVER (ORDER BY date) / 365 / 100, date - lag(date) OVER (ORDER BY date)) - 1 + 1e-9, 6) + 0.0 AS value FROM rates")
def risk_free_return(spark, d):
    return signals.risk_free_returns(rates(spark, d))


def ratio_panel(spark, d):
    """Statement items and market caps on the months from the first to the last known report."""
    stmt = statements(spark, d)
    months = stmt.select(F.last_day(F.add_months("report_date", 1)).alias("m")).agg(F.min("m").alias("a"), F.max("m").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("x")).select(F.last_day("x").alias("date")).distinct()
    items = reported(stmt, months, stmt.select("symbol"))
    return items.join(market_cap_panel(market_caps(spark, d)), ["date", "symbol"], "left")


@register("statement_panel", f"WITH {STATEMENTS} SELECT date, symbol, {r6('totalRevenue', 'netIncome', 'market_cap')} FROM p")
def statement_panel(spark, d):
    return ratio_panel(spark, d).select("date", "symbol", "totalRevenue", "netIncome", "market_cap")


@register("market_cap_panel", f"WITH {STATEMENTS} SELECT date, symbol, {r6('market_cap')} FROM caps WHERE symbol IN (SELECT symbol FROM caps GROUP BY 1 HAVING count(*) > 2)")
def market_cap(spark, d):
    return market_cap_panel(market_caps(spark, d))


def _year(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {rolling(x, 12, 4)} END"


def _grown(x: str) -> str:
    return f"{x} / ({lag(x, 12)} + 1e-6) - 1"


def _over(x: str, y: str) -> str:
    return f"({x}) / nullif(({y}) + 1e-10, 0)"


_EV = "market_cap + longTermDebt + shortTermDebt - cashAndEquivalents"
#: The SQL of each ratio, written out apart from the operator's own table of rules.
RATIO_SQL = {
    Ratio.ROA: _over("y_income", "assets_before"),
    Ratio.ROE: _over("y_income", "equity_before"),
    Ratio.ROIC: _over("y_ebit * (1 - y_tax / (y_pretax + 1e-10))", "invested_before"),
    Ratio.GROSS_MARGIN: _over("y_gross", "y_revenue"),
    Ratio.OPERATING_MARGIN: _over("y_ebit", "y_revenue"),
    Ratio.NET_MARGIN: _over("y_income", "y_revenue"),
    Ratio.FCF_YIELD: _over("y_fcf", "market_cap"),
    Ratio.CASH_FLOW_MARGIN: _over("y_fcf", "y_revenue"),
    Ratio.CASH_FLOW_TO_INCOME: _over("y_fcf", "y_income"),
    Ratio.NET_PAYOUT_YIELD: _over("y_payout", "market_cap"),
    Ratio.EQUITY_ISSUANCE: _grown("f_shares"),
    Ratio.ASSET_GROWTH: _grown("f_assets"),
    Ratio.BOOK_GROWTH: _grown("f_equity"),
    Ratio.CAPEX_GROWTH: _grown("f_capex"),
    Ratio.EARNINGS_GROWTH: _grown("f_income"),
    Ratio.FIXED_ASSETS_GROWTH: _grown("f_fixed"),
    Ratio.NET_DEBT_GROWTH: _grown("f_debt"),
    Ratio.EARNINGS_TO_PRICE: _over("y_income", "market_cap"),
    Ratio.SALES_TO_EV: _over("y_revenue", _EV),
    Ratio.SALES_TO_PRICE: _over("y_revenue", "market_cap"),
    Ratio.BOOK_TO_PRICE: _over("totalStockholderEquity", "market_cap"),
    Ratio.EBITDA_TO_EV: _over("y_ebitda", _EV),
    Ratio.FCF_TO_EV: _over("y_fcf", _EV),
}
_inside = lambda x, name: f"{INSIDE.format(x=x)} AS {name}"
RATIOS = f"""{STATEMENTS}, yearly AS (SELECT *, {_year('netIncome')} AS y_income, {_year('totalRevenue')} AS y_revenue, {_year('grossProfit')} AS y_gross,
  {_year('ebit')} AS y_ebit, {_year('ebitda')} AS y_ebitda, {_year('freeCashFlow')} AS y_fcf, {_year('incomeTaxExpense')} AS y_tax, {_year('incomeBeforeTax')} AS y_pretax,
  {_year('(netIncome - salePurchaseOfStock)')} AS y_payout,
  {lag('totalAssets', 12)} AS assets_before, {lag('totalStockholderEquity', 12)} AS equity_before, {lag('netInvestedCapital', 12)} AS invested_before FROM p),
filled AS (SELECT *, {_inside('commonStockSharesOutstanding', 'f_shares')}, {_inside('totalAssets', 'f_assets')}, {_inside('totalStockholderEquity', 'f_equity')},
  {_inside('capitalExpenditures', 'f_capex')}, {_inside('propertyPlantEquipment', 'f_fixed')}, {_inside('netDebt', 'f_debt')}, {_inside('y_income', 'f_income')} FROM yearly)"""


def _ratio(name: Ratio):
    @register(f"ratio_{name.value.lower()}", f"WITH {RATIOS} SELECT date, symbol, round({RATIO_SQL[name]} + 1e-9, 6) + 0.0 AS ratio FROM filled")
    def query(spark, d):
        return with_ratios(ratio_panel(spark, d), [name]).select("date", "symbol", F.col(str(name)).alias("ratio"))


for _name in Ratio:
    _ratio(_name)

