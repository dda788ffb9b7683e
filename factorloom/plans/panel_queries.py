"""Construction, alignment, reshaping, cleaning and filtering of panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.calendar import business_days_ahead, month_ends_ahead, numbered, offset
from ..functions.scalar import clipped, floored
from ..operators import cleaning, panel
from ..operators.predicates import (
    Thresholds, daily_rules, equal_to, in_range, missing, monthly_rules, not_missing, whole_column_in_range, whole_row_in_range,
)
from ..sources.tables import daily_facts, panel_d, panel_m, prices, rates, table
from .base import BY, PD, PM, RATES, RAW_B, RAW_D, lag, r6, register, rolling, rows

FIELDS = ("close", "adjusted_close", "volume")
BRANDS = range(1, 26)  # the brands of the tables


@register("dense_spine", f"WITH {PM} SELECT date, symbol, {r6(*FIELDS)} FROM p")
def dense_spine(spark, d):
    return panel_m(spark, d)


@register("align_panel", f"""WITH {PM}, m AS (SELECT DISTINCT last_day(CAST(x AS DATE)) AS date FROM (SELECT unnest(generate_series(
  (SELECT date_trunc('month', min(o_orderdate))::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 MONTH)) AS x))
SELECT m.date, s.symbol, {r6(*FIELDS)} FROM m CROSS JOIN (SELECT DISTINCT p_brand AS symbol FROM part) s LEFT JOIN p ON p.date = m.date AND p.symbol = s.symbol""")
def align_panel(spark, d):
    """The prices on the months of the orders, and all brands."""
    ends = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    months = ends.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("date"))
    return panel.align(panel_m(spark, d), months, table(spark, d, "part").select(F.col("p_brand").alias("symbol")))


@register("broadcast_series", f"WITH {RATES} SELECT date, {r6('value')}, r_name AS symbol FROM rates CROSS JOIN region")
def broadcast_series(spark, d):
    return panel.spread_series(rates(spark, d).drop("series_id"), table(spark, d, "region").select(F.col("r_name").alias("symbol")))


@register("broadcast_row", f"WITH {RATES} SELECT date, n_name AS symbol, CAST(n_regionkey AS DOUBLE) AS value FROM rates CROSS JOIN nation")
def broadcast_row(spark, d):
    row = table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_regionkey").cast("double").alias("value"))
    return panel.spread_row(row, rates(spark, d))


@register("init_panel", f"WITH {PM} SELECT date, symbol, 1.0::DOUBLE AS value FROM p")
def init_panel(spark, d):
    base = panel_m(spark, d)
    return panel.ones(base, base)


_LAST = "last({x} ORDER BY date) FILTER (WHERE {x} IS NOT NULL)"


@register("resample_month_last", f"WITH {PD} SELECT last_day(date) AS date, symbol, round(arg_max(adjusted_close, date) + 1e-9, 6) + 0.0 AS adjusted_close FROM p GROUP BY 1, 2")
def resample_month_last(spark, d):
    return panel.month_last(panel_d(spark, d), "adjusted_close")


@register("downsample_ohlcv", f"""WITH {PD} SELECT last_day(date) AS date, symbol, round(arg_max(close, date) + 1e-9, 6) + 0.0 AS close,
round(arg_max(adjusted_close, date) + 1e-9, 6) + 0.0 AS adjusted_close, round(coalesce(sum(volume), 0) + 1e-9, 6) + 0.0 AS volume FROM p GROUP BY 1, 2""")
def downsample_ohlcv(spark, d):
    return panel.downsample(panel_d(spark, d))


@register("pivot_panel", f"""WITH {PM} SELECT date, {', '.join(f"round(max(CASE WHEN symbol = 'Brand#{k}' THEN adjusted_close END) + 1e-9, 6) + 0.0 AS brand{k}" for k in BRANDS)} FROM p GROUP BY 1""")
def pivot_panel(spark, d):
    wide = panel.pivoted(panel_m(spark, d), "adjusted_close", [f"Brand#{k}" for k in BRANDS])
    return wide.select("date", *[F.col(f"`Brand#{k}`").alias(f"brand{k}") for k in BRANDS])


@register("unpivot_panel", f"WITH {PM} SELECT date, symbol, round(adjusted_close + 1e-9, 6) + 0.0 AS value FROM p")
def unpivot_panel(spark, d):
    return panel.unpivoted(panel.pivoted(panel_m(spark, d), "adjusted_close"))


@register("flatten_panel", f"WITH {PM} SELECT date, symbol, {r6('adjusted_close')} FROM p WHERE coalesce(volume >= 500, false)")
def flatten_panel(spark, d):
    return panel.flatten(panel_m(spark, d), equal_to(True)(F.col("volume") >= 500)).select("date", "symbol", "adjusted_close")


@register("zip_panels", f"WITH {PM} SELECT date, symbol, {r6('close', 'volume')} FROM p")
def zip_panels(spark, d):
    base = panel_m(spark, d)
    return panel.zipped(base.select("date", "symbol", "close"), base.select("date", "symbol", "volume"))


@register("month_end_offsets", """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, last_day(date + CASE WHEN date = last_day(date) THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) AS next1,
CASE WHEN date = last_day(date) THEN last_day(date_trunc('month', date)::DATE + INTERVAL 3 MONTH) ELSE last_day(date_trunc('month', date)::DATE + INTERVAL 2 MONTH) END AS next3,
last_day(date_trunc('month', date)::DATE - INTERVAL 2 MONTH) AS back2,
CAST(date + INTERVAL 7 DAY AS DATE) AS week,
CASE WHEN month(date) = 12 AND day(date) = 31 THEN make_date(year(date) + 1, 12, 31) ELSE make_date(year(date), 12, 31) END AS year_end FROM o""")
def month_end_offsets(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    at = F.col("date")
    return days.select(
        "date", month_ends_ahead(at, 1).alias("next1"), month_ends_ahead(at, 3).alias("next3"), month_ends_ahead(at, -2).alias("back2"),
        offset(at, "w").alias("week"), offset(at, "y").alias("year_end"),
    )


@register("business_day_offset", f"""WITH {RAW_D}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM raw))
SELECT a.date, b.date AS moved FROM c a LEFT JOIN c b ON b.pos = a.pos + 5""")
def business_day_offset(spark, d):
    calendar = numbered(daily_facts(spark, d))
    return business_days_ahead(calendar.select("date"), calendar, 5)


@register("calendar_semi", f"WITH {PD} SELECT date, symbol, {r6('adjusted_close')} FROM p WHERE dayofweek(date) BETWEEN 1 AND 5")
def calendar_semi(spark, d):
    base = panel_d(spark, d)
    weekdays = base.select("date").distinct().filter(F.dayofweek("date").between(2, 6))
    return panel.on_calendar(base, weekdays).select("date", "symbol", "adjusted_close")


@register("date_clip", f"WITH {PD} SELECT date, symbol, {r6('adjusted_close')} FROM p WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'")
def date_clip(spark, d):
    return panel.between(panel_d(spark, d), "1996-03-01", "1997-02-28").select("date", "symbol", "adjusted_close")


@register("drop_sparse_symbols", f"WITH {PD} SELECT date, symbol, {r6('adjusted_close')} FROM p WHERE symbol IN (SELECT symbol FROM p GROUP BY 1 HAVING count(adjusted_close) >= 2450)")
def drop_sparse_symbols(spark, d):
    return cleaning.with_history(panel_d(spark, d), "adjusted_close", 2450).select("date", "symbol", "adjusted_close")


def _pass(k: int) -> str:
    def top(x):
        return f"greatest({x}, 0.0001)"

    x, b, a = "adjusted_close", "b", "a"
    spike = f"""(({x} / {top(b)} < 0.5 AND {a} / {top(x)} > 1.9) OR ({x} / {top(b)} > 1.9 AND {a} / {top(x)} < 0.5)) AND b > 1 AND a > 1"""
    return f"""s{k} AS (SELECT * EXCLUDE (b, a) FROM (SELECT *, lag({x}) OVER ({BY}) AS b, lead({x}) OVER ({BY}) AS a FROM s{k - 1}) WHERE NOT coalesce({spike}, false))"""


SPIKES = f"s0 AS (SELECT * FROM raw WHERE volume > 0), {', '.join(_pass(k) for k in range(1, 7))}"


@register("spike_clean", f"WITH {RAW_D}, {SPIKES} SELECT date, symbol, {r6(*FIELDS)} FROM s6")
def spike_clean(spark, d):
    return cleaning.without_spikes(daily_facts(spark, d))


@register("floor_and_clip", f"WITH {PM} SELECT date, symbol, round(CASE WHEN close IS NOT NULL THEN greatest(close, 1400::DOUBLE) END + 1e-9, 6) + 0.0 AS floored, round(CASE WHEN close IS NOT NULL THEN least(greatest(close, 1300::DOUBLE), 1500::DOUBLE) END + 1e-9, 6) + 0.0 AS clipped FROM p")
def floor_and_clip(spark, d):
    x = F.col("close")
    return panel_m(spark, d).select("date", "symbol", floored(x, 1400).alias("floored"), clipped(x, 1300, 1500).alias("clipped"))


def _masks(name, sql_tests: dict, tests: dict):
    body = ", ".join(f"{e} AS {n}" for n, e in sql_tests.items())

    @register(name, f"WITH {PM} SELECT date, symbol, {body} FROM p")
    def query(spark, d):
        return panel_m(spark, d).select("date", "symbol", *[t().alias(n) for n, t in tests.items()])




def _of(field, test):
    return lambda: test(F.col(field))


_masks("filter_equal", {"m": "coalesce(volume = 600, false)"}, {"m": _of("volume", equal_to(600.0))})
_masks(
    "filter_range",
    {
        "both": "coalesce(volume >= 500 AND volume <= 600, false)", "neither": "coalesce(volume > 500 AND volume < 600, false)",
        "low": "coalesce(volume >= 500 AND volume < 600, false)", "high": "coalesce(volume > 500 AND volume <= 600, false)",
        "only_low": "coalesce(volume >= 500, false)",
    },
    {
        "both": _of("volume", in_range(500, 600)), "neither": _of("volume", in_range(500, 600, False, False)), "low": _of("volume", in_range(500, 600, True, False)),
        "high": _of("volume", in_range(500, 600, False, True)), "only_low": _of("volume", in_range(500)),
    },
)
_masks(
    "filter_column_all",
    {"lenient": "bool_and(volume IS NULL OR volume >= 300) OVER (PARTITION BY symbol)", "strict": "bool_and(coalesce(volume >= 300, false)) OVER (PARTITION BY symbol)"},
    {"lenient": _of("volume", whole_column_in_range(300)), "strict": _of("volume", whole_column_in_range(300, ignore_missing=False))},
)
_masks(
    "filter_row_all",
    {"lenient": "bool_and(volume IS NULL OR volume >= 400) OVER (PARTITION BY date)", "strict": "bool_and(coalesce(volume >= 400, false)) OVER (PARTITION BY date)"},
    {"lenient": _of("volume", whole_row_in_range(400)), "strict": _of("volume", whole_row_in_range(400, ignore_missing=False))},
)
_masks("filter_null", {"there": "close IS NOT NULL", "gone": "close IS NULL"}, {"there": _of("close", not_missing), "gone": _of("close", missing)})

AT = Thresholds(min_price=1000.0, min_volume=424.0, max_return=0.7, max_missing_days=28)


def monthly_mask(spark, d):
    """The monthly panel with `good`, under thresholds that bite on these tables; missing days are those of the symbol."""
    daily = panel.dense(prices(spark, d, "p_brand", False)).withColumn("missing_days", w.rolling_missing(F.col("adjusted_close"), 63))
    return monthly_rules(AT).good(panel_m(spark, d).join(panel.month_last(daily, "missing_days"), panel.KEYS, "left"))


MASK_SQL = f"""{PM}, {RAW_B.replace("raw AS", "raw_b AS")}, dd AS (SELECT d.date, s.symbol, adjusted_close AS x FROM (SELECT DISTINCT date FROM raw_b) d CROSS JOIN (SELECT DISTINCT symbol FROM raw_b) s
  LEFT JOIN raw_b ON raw_b.date = d.date AND raw_b.symbol = s.symbol),
gaps AS (SELECT last_day(date) AS date, symbol, arg_max(k, date) AS missing_days FROM (SELECT date, symbol, CASE WHEN count(*) {rows(63)} >= 63 THEN count(*) {rows(63)} - count(x) {rows(63)} END AS k FROM dd) WHERE k IS NOT NULL GROUP BY 1, 2),
w AS (SELECT p.*, missing_days, {rolling('adjusted_close', 12, None, 'avg')} AS full12, {rolling('close', 3, 1, 'min')} AS c3, {rolling('adjusted_close', 3, 1, 'min')} AS a3,
  {rolling('volume', 12, None, 'min')} AS v12, adjusted_close / {lag('adjusted_close', 1)} - 1 AS ret FROM p LEFT JOIN gaps USING (date, symbol)),
mask AS (SELECT *, close IS NOT NULL AND adjusted_close IS NOT NULL AND full12 IS NOT NULL AND coalesce(missing_days <= 28, false) AND volume IS NOT NULL
  AND coalesce(c3 >= 1000, false) AND coalesce(a3 >= 1000, false) AND coalesce(v12 >= 424, false) AND bool_and(ret IS NULL OR ret <= 0.7) OVER (PARTITION BY symbol) AS good FROM w)"""


@register("default_mask_m", f"WITH {MASK_SQL} SELECT date, symbol, good FROM mask")
def default_mask_m(spark, d):
    return monthly_mask(spark, d).select("date", "symbol", "good")


@register("default_mask_d", f"""WITH {PD}, f AS (SELECT *, last_value(adjusted_close IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS filled, {rolling('adjusted_close', 63, 1, 'min')} AS low FROM p)
SELECT date, symbol, adjusted_close IS NOT NULL AND coalesce(adjusted_close >= 900, false) AND coalesce(low >= 900, false) AND coalesce(filled / {lag('filled', 1)} - 1 <= 0.6, false) AS good FROM f""")
def default_mask_d(spark, d):
    return daily_rules(Thresholds(min_price=900.0, max_return=0.6)).good(panel_d(spark, d)).select("date", "symbol", "good")
