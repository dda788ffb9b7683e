"""Ranking and bucketing of symbols on each date. Ties are ordered by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_date


def ordinal(x: Column) -> Column:
    """Rank 0.. of the values of a date; missing values rank last."""
    return F.row_number().over(by_date().orderBy(x.asc_nulls_last(), "symbol")) - 1


def percentile_rank(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_divide(ordinal(x), F.count(x).over(by_date()) - 1))


def rank_bucket(x: Column, n: int) -> Column:
    """Equal-width buckets 0..n-1 of the percentile rank; -1 where missing, n-1 if alone."""
    many = F.count(x).over(by_date())
    inside = F.least(F.floor(F.try_divide(ordinal(x) * n, many - 1)), F.lit(n - 1))
    return F.when(x.isNull(), -1).when(many == 1, n - 1).otherwise(inside).cast("int")


def quantile_bucket(rows: DataFrame, metric: str, n: int, name: str = "bucket") -> DataFrame:
    """rows with the bucket 1..n of the metric by its date's linear quantiles; the last edge is in n.

    Edges are exact percentiles of a date, joined back: a date is one group of symbols.
    """
    shares = ", ".join(f"{min(1.0, k * (1 / n))!r}D" for k in range(n + 1))
    edges = rows.groupBy("date").agg(F.expr(f"percentile({metric}, array({shares}))").alias("_edges"))
    reached = F.size(F.filter("_edges", lambda e: e <= F.col(metric)))
    return rows.join(edges, "date").withColumn(name, F.least(reached, F.lit(n))).drop("_edges")


def top_k(rows: DataFrame, score: str, k: int, name: str = "slot") -> DataFrame:
    """The k best rows of each date, numbered from 1."""
    best = F.row_number().over(by_date().orderBy(F.col(score).desc_nulls_last(), "symbol"))
    return rows.withColumn(name, best).filter(F.col(name) <= k)


def top_k_mean(rows: DataFrame, score: str, label: str, k: int, name: str = "mean") -> DataFrame:
    return top_k(rows, score, k).groupBy("date").agg(F.avg(label).alias(name))


def ndcg(rows: DataFrame, label: str, score: str, k: int | None = None, form: str = "exp", n_labels: int | None = None, bear: bool = False, name: str = "ndcg") -> DataFrame:
    """Normalised discounted gain of each date; bear turns labels (of n_labels) around."""
    if form not in ("exp", "linear"):
        raise ValueError(f"unknown form {form!r}")
    y = F.lit(n_labels - 1) - F.col(label) if bear else F.col(label)
    worth = F.pow(F.lit(2.0), y) - 1 if form == "exp" else y.cast("double")
    found = F.row_number().over(by_date().orderBy(F.col(score).desc_nulls_last(), "symbol"))
    ideal = F.row_number().over(by_date().orderBy(y.desc_nulls_last(), "symbol"))
    ranked = rows.select("date", worth.alias("worth"), found.alias("found"), ideal.alias("ideal"))
    cut = lambda place: F.sum(F.when(F.lit(True) if k is None else F.col(place) <= k, F.col("worth") / F.log2(F.col(place) + 1)))
    return ranked.groupBy("date").agg(F.try_divide(cut("found"), cut("ideal")).alias(name))
