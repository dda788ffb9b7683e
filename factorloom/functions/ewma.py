"""Exponentially weighted means along dates, without a running state.

Weights q^k with q = 1 - 1/n decay by rows; missing rows carry the mean on. The closed form
overflows over long histories, so that rows are cut into blocks: cumulated sums inside a block, one
carry for each block from those before it, folded over a short array per symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def ewma(panel: DataFrame, field: str, spans: list[int], block: int = BLOCK) -> DataFrame:
    """The dense panel with a column <field>_ewma_<n> for each n."""
    order = Window.partitionBy("symbol").orderBy("date")
    rows = panel.withColumn("_i", F.row_number().over(order) - 1)
    rows = rows.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_o", F.col("_i") % block)
    inside = Window.partitionBy("symbol", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    there = F.col(field).isNotNull()
    for n in spans:
        q = 1 - 1 / n
        weight = F.pow(F.lit(q), -F.col("_o"))
        rows = rows.withColumn(f"_n{n}", F.coalesce(F.sum(F.col(field) * weight).over(inside), F.lit(0.0)) / weight)
        rows = rows.withColumn(f"_d{n}", F.coalesce(F.sum(F.when(there, weight)).over(inside), F.lit(0.0)) / weight)
    ends = rows.groupBy("symbol", "_b").agg(
        F.max("_o").alias("last"), *[F.max_by(f"_{c}{n}", "_i").alias(f"_{c}{n}") for n in spans for c in "nd"]
    )
    state = ["last", *[f"_{c}{n}" for n in spans for c in "nd"]]
    blocks = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_b", *state))).alias("all"))

    def fold(acc, x):
        step = [(acc[f"_{c}{n}"] * F.pow(F.lit(1 - 1 / n), x["last"] + 1) + x[f"_{c}{n}"]).alias(f"_{c}{n}") for n in spans for c in "nd"]
        carry = F.struct(x["_b"].alias("_b"), *[acc[f"_{c}{n}"].alias(f"c{c}{n}") for n in spans for c in "nd"])
        return F.struct(*step, F.concat(acc["out"], F.array(carry)).alias("out"))

    empty = "array<struct<_b:bigint," + ",".join(f"c{c}{n}:double" for n in spans for c in "nd") + ">>"
    start = F.struct(*[F.lit(0.0).alias(f"_{c}{n}") for n in spans for c in "nd"], F.array().cast(empty).alias("out"))
    carried = blocks.select("symbol", F.inline(F.aggregate("all", start, fold)["out"]))
    joined = rows.join(carried, ["symbol", "_b"], "left")
    for n in spans:
        decay = F.pow(F.lit(1 - 1 / n), F.col("_o") + 1)
        top, bottom = F.col(f"_n{n}") + F.col(f"cn{n}") * decay, F.col(f"_d{n}") + F.col(f"cd{n}") * decay
        joined = joined.withColumn(f"{field}_ewma_{n}", F.try_divide(top, bottom))
    return joined.drop("_i", "_b", "_o", *[f"{p}{c}{n}" for n in spans for c in "nd" for p in ("_", "c")])
