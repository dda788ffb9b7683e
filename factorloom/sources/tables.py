"""Panels made of the driver's tables. lineitem has no unique key: every view aggregates first."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..operators.panel import dense
from .shared import kept

#: Facts of the query that runs; each thread of the driver has its own.
_facts: ContextVar[dict | None] = ContextVar("facts", default=None)


def fresh() -> None:
    """Forgets the facts of earlier queries; their tables may have changed."""
    _facts.set({})


def once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """Aggregated facts, written to the shared folder once in a query, however often its plan uses them."""
    key, facts = (spark.sparkContext.applicationId, *key), _facts.get()
    if facts is None:
        _facts.set(facts := {})
    if key not in facts:
        facts[key] = kept(make(), key[1])
    return facts[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str, symbol: str, monthly: bool) -> DataFrame:
    """(date, symbol, close, adjusted_close, volume) by brand and month, or by part type and day."""
    return once(spark, ("prices", sf_dir, symbol, monthly), lambda: _prices(spark, sf_dir, symbol, monthly))


def _prices(spark: SparkSession, sf_dir: str, symbol: str, monthly: bool) -> DataFrame:
    day = F.to_date("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy((month_end(day) if monthly else day).alias("date"), F.col(symbol).alias("symbol")).agg(
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-9, 6).alias("close"),
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + 1e-9, 6).alias("adjusted_close"),
        F.sum("l_quantity").alias("volume"),
    )


def nation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, symbol, close, adjusted_close, volume) by the customer's nation and the day of shipping: prices of the
    symbols that have statements and market caps."""
    return once(spark, ("nation_prices", sf_dir), lambda: _nation_prices(spark, sf_dir))


def _nation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return rows.groupBy(F.to_date("l_shipdate").alias("date"), F.col("c_nationkey").cast("string").alias("symbol")).agg(
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-9, 6).alias("close"),
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + 1e-9, 6).alias("adjusted_close"),
        F.sum("l_quantity").alias("volume"),
    )


def daily_facts(spark, sf_dir):
    return prices(spark, sf_dir, "p_type", False)


def panel_m(spark, sf_dir):
    return dense(prices(spark, sf_dir, "p_brand", True))


def panel_d(spark, sf_dir):
    return dense(daily_facts(spark, sf_dir))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly items by nation, derived from order lines by fixed shares."""
    return once(spark, ("statements", sf_dir), lambda: _statements(spark, sf_dir))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    quarter = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    sums = rows.groupBy(F.col("c_nationkey").cast("string").alias("symbol"), quarter.alias("report_date")).agg(
        F.sum("l_extendedprice").alias("g"), F.sum(net).alias("r"), F.sum(net * F.col("l_tax")).alias("t"), F.sum("l_quantity").alias("q")
    )
    return sums.select("symbol", "report_date", *[F.expr(e).alias(n) for n, e in ITEMS.items()])


#: What share of the sums g, r, t and q each item is.
ITEMS = {
    "totalRevenue": "r", "grossProfit": "r - 0.60D * g", "ebitda": "r - 0.75D * g", "ebit": "r - 0.80D * g",
    "incomeBeforeTax": "r - 0.80D * g - 0.01D * g", "incomeTaxExpense": "t", "netIncome": "r - 0.80D * g - 0.01D * g - t",
    "capitalExpenditures": "0.05D * g", "freeCashFlow": "r - 0.75D * g - t - 0.05D * g", "dividendsPaid": "0.02D * g",
    "salePurchaseOfStock": "-0.01D * g", "totalAssets": "10D * g", "totalStockholderEquity": "4D * g", "netInvestedCapital": "6D * g",
    "longTermDebt": "2D * g", "shortTermDebt": "0.5D * g", "cashAndEquivalents": "0.8D * g", "netDebt": "1.7D * g",
    "propertyPlantEquipment": "3D * g", "commonStockSharesOutstanding": "q",
}


def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("market_caps", sf_dir), lambda: _market_caps(spark, sf_dir))


def _market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.last_day(F.to_date("o_orderdate")).alias("date"), F.col("c_nationkey").cast("string").alias("symbol")).agg(F.sum("o_totalprice").alias("market_cap"))


def market_cap_panel(raw: DataFrame, least_months: int = 3) -> DataFrame:
    """Month-last caps of the symbols with that many months."""
    monthly = raw.groupBy(month_end(F.col("date")).alias("date"), "symbol").agg(F.max_by("market_cap", "date").alias("market_cap"))
    many = monthly.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") >= least_months)
    return monthly.join(many, "symbol", "left_semi")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, value): the day's mean of one kind of event, as a rate series."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return rows.groupBy(F.to_date("ts").alias("date")).agg(F.round(F.avg("value") + 1e-9, 6).alias("value")).select(F.lit("DGS1MO").alias("series_id"), "date", "value")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, symbol, f1, f2, y): vectors as symbols, their labels as dates."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("label")).alias("date"), F.col("vec_id").cast("string").alias("symbol"),
        *[F.col("embedding")[k].cast("double").alias(f"f{k + 1}") for k in range(3)], (F.col("vec_id") % 5).cast("int").alias("y"),
    )
