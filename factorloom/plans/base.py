"""SQL counterparts of the base panels, and helpers that both sides of a query share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ITEMS, fresh

_PRICES = """SELECT {date} AS date, {symbol} AS symbol, round(avg(l_extendedprice / l_quantity) + 1e-9, 6) AS close,
  round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) AS adjusted_close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
_DENSE = """SELECT d.date, s.symbol, close, adjusted_close, volume FROM (SELECT DISTINCT date FROM raw) d
  CROSS JOIN (SELECT DISTINCT symbol FROM raw) s LEFT JOIN raw ON raw.date = d.date AND raw.symbol = s.symbol"""
RAW_D = f"raw AS ({_PRICES.format(date='CAST(l_shipdate AS DATE)', symbol='p_type')})"
RAW_B = f"raw AS ({_PRICES.format(date='CAST(l_shipdate AS DATE)', symbol='p_brand')})"
RAW_N = """raw AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(c_nationkey AS VARCHAR) AS symbol, round(avg(l_extendedprice / l_quantity) + 1e-9, 6) AS close,
  round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) AS adjusted_close, sum(l_quantity) AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
PM = f"raw AS ({_PRICES.format(date='last_day(CAST(l_shipdate AS DATE))', symbol='p_brand')}), p AS ({_DENSE})"
PD = f"{RAW_D}, p AS ({_DENSE})"
RATES = "rates AS (SELECT CAST(ts AS DATE) AS date, round(avg(value) + 1e-9, 6) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)"
SCORED = """scored AS (SELECT DATE '2024-01-01' + CAST(label AS INTEGER) AS date, CAST(vec_id AS VARCHAR) AS symbol,
  CAST(embedding[1] AS DOUBLE) AS f1, CAST(embedding[2] AS DOUBLE) AS f2, CAST(embedding[3] AS DOUBLE) AS f3, CAST(vec_id % 5 AS INTEGER) AS y FROM embeddings)"""
_items = ", ".join(f"{e.replace('D *', '::DOUBLE *')} AS {n}" for n, e in ITEMS.items())
STATEMENTS = f"""sums AS (SELECT CAST(c_nationkey AS VARCHAR) AS symbol,
  last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS report_date,
  sum(l_extendedprice) AS g, sum(l_extendedprice * (1 - l_discount)) AS r, sum(l_extendedprice * (1 - l_discount) * l_tax) AS t, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
stmt AS (SELECT symbol, report_date, {_items} FROM sums),
caps AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, CAST(c_nationkey AS VARCHAR) AS symbol, sum(o_totalprice) AS market_cap
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
known AS (SELECT last_day(last_day(report_date) + INTERVAL 1 DAY) AS date, * EXCLUDE (report_date) FROM stmt),
months AS (SELECT DISTINCT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(
  (SELECT min(date) FROM known), (SELECT max(date) FROM known), INTERVAL 1 MONTH)) AS m)),
p AS (SELECT m.date, s.symbol, known.* EXCLUDE (date, symbol), market_cap FROM months m CROSS JOIN (SELECT DISTINCT symbol FROM stmt) s
  LEFT JOIN known ON known.date = m.date AND known.symbol = s.symbol LEFT JOIN caps ON caps.date = m.date AND caps.symbol = s.symbol)"""

BY = "PARTITION BY symbol ORDER BY date"


def rows(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({BY})" if n >= 0 else f"lead({x}, {-n}) OVER ({BY})"


def floor(x: str, least: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, {least!r}::DOUBLE) END"


def mom(x: str, n: int, k: int = 0) -> str:
    return f"ln(({floor(lag(x, k), 1e-4)}) / ({floor(lag(x, n), 1e-4)}))"


def fut(x: str, n: int) -> str:
    return f"({floor(lag(x, -n), 1e-4)}) / ({floor(x, 1e-4)}) - 1"


def rolling(x: str, n: int, least: int | None = None, how: str = "sum") -> str:
    return f"CASE WHEN count({x}) {rows(n)} >= {n if least is None else least} THEN {how}({x}) {rows(n)} END"


def logret(x: str) -> str:
    return f"CASE WHEN abs({x}) > 1e-8 AND abs({lag(x, 1)}) > 1e-8 THEN ln(({floor(x, 1e-4)}) / ({floor(lag(x, 1), 1e-4)})) END"


def r6(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) + 0.0 AS {n}" for n in names)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, as the SQL side has them."""
    return df.select(*[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None, round_it: bool = True):
    """Adds a query (spark, sf_dir) -> DataFrame and its SQL."""

    def add(f):
        def run(spark, d):
            fresh()
            found = f(spark, d)
            return rounded(found) if round_it else found

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
