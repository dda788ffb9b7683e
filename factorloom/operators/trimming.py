"""Cuts from two sides, date by date, in rounds of Spark jobs.

A cut takes the rows of a group up to the fraction-quantile of those left, by score or by the antagonist's score from
above; a pass makes both, as far as each leaves k rows. A group's passes end with the first in which a cut did not
come about. What is left of a group is known by two thresholds, so that a round rewrites a row for each group and no
other: it counts the values left by blocks of values, finds the block that holds the order statistic, and orders that
block's distinct values only. Rounds go on while a group has more than SMALL rows left; the cuts of what is then left of a
group are made by one task. Once half of the rows that rounds read are gone, the others are written anew.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, kept

BLOCKS = 64  # of a group's values, by mergeable quantiles
ACCURACY = 1000
SMALL = 1 << 16  # rows left of a group whose other cuts one task makes


def trimmed(rows: DataFrame, by: list[str], score: str, against: str, fraction: float, k: int) -> DataFrame:
    """rows with `left`: whether the cuts leave them. Rows without a score count in no quantile and are not cut by it."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    known = kept(rows.withColumns({"_k0": number(score), "_k1": -number(against)}), "scores")
    thresholds = [F.lit(None).cast("double").alias(f"_t{s}") for s in (0, 1)]
    state = kept(known.groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", *thresholds, F.lit(True).alias("going"), (F.col("n") > SMALL).alias("large"), F.lit(True).alias("whole")), "state")
    placed = written = None
    while todo := state.filter("large").agg(F.sum("n")).first()[0]:
        if placed is None:
            placed, written = kept(_blocks(known, state, by), "placed"), todo
        elif todo * 2 <= written:
            before, placed, written = placed, kept(_met(placed, state.filter("large").select(*by, "_t0", "_t1"), by).filter(_left()).select(*placed.columns), "placed"), todo
            discard(before)
        for side in (0, 1):
            before, state = state, kept(_cut(placed, state, by, side, fraction, k), "state")
            discard(before)
        going = F.col("going") & F.col("whole") & (F.col("n") > 0)
        before, state = state, kept(state.withColumns({"going": going, "large": F.col("large") & going & (F.col("n") > SMALL)}), "state")
        discard(before)
    if placed is not None:
        discard(placed)
    going = state.filter("going").select(*by, "_t0", "_t1")
    alive = _met(known, going, by).filter(_left()).select(*by, "_k0", "_k1", "_t0", "_t1")
    ended = alive.groupBy(*by).applyInArrow(_finishing(by, fraction, k), going.schema)
    found = kept(state.filter("NOT going").select(*by, "_t0", "_t1").unionByName(ended), "thresholds")
    return _met(known, found, by).withColumn("left", _left()).select(*rows.columns, "left")


def _blocks(known: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Both values of the rows of large groups, and their blocks."""
    mine = _met(known, state.filter("large").select(*by), by)
    shares = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    edges = mine.groupBy(*by).agg(*[F.percentile_approx(f"_k{s}", shares, ACCURACY).alias(f"_e{s}") for s in (0, 1)])
    blocks = lambda s: F.size(F.filter(F.coalesce(f"_e{s}", F.array().cast("array<double>")), lambda e: e < F.col(f"_k{s}"))).alias(f"_b{s}")
    return _met(mine, edges, by).select(*by, "_k0", "_k1", blocks(0), blocks(1))


def _finishing(by: list[str], fraction: float, k: int):
    """The thresholds of a group after all its cuts, from what is left of it."""

    def run(group: pa.Table) -> pa.Table:
        keys = [group[f"_k{s}"].to_numpy().astype(float) for s in (0, 1)]
        limits, left, whole = [group[f"_t{s}"][0].as_py() for s in (0, 1)], np.arange(len(group)), True
        while whole and len(left):
            for s, key in enumerate(keys):
                values = key[left]
                values, cut = values[~np.isnan(values)], None
                if len(values):
                    at = int(np.floor((len(values) - 1) * fraction))
                    cut = np.partition(values, at)[at]
                rest = left if cut is None else left[~(key[left] <= cut)]
                whole = whole and k <= len(rest) < len(left)
                if cut is not None and len(rest) >= k:
                    left, limits[s] = rest, float(cut)
        out = group.select(by).slice(0, 1)
        for s in (0, 1):
            out = out.append_column(f"_t{s}", pa.array([limits[s]], pa.float64()))
        return out

    return run


def _left() -> Column:
    stays = [F.col(f"_t{s}").isNull() | F.col(f"_k{s}").isNull() | (F.col(f"_k{s}") > F.col(f"_t{s}")) for s in (0, 1)]
    return stays[0] & stays[1]


def _met(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows beside their group's row; null keys are keys."""
    names = {c: f"_g_{c}" for c in by}
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(names[c])) for c in by])
    return rows.join(groups.withColumnsRenamed(names), same, how).drop(*names.values())


def _cut(placed: DataFrame, state: DataFrame, by: list[str], side: int, fraction: float, k: int) -> DataFrame:
    """The state after one cut of the groups that are large when the pass begins."""
    going = state.filter("large").select(*by, "_t0", "_t1")
    alive = _met(placed, going, by).filter(_left() & F.col(f"_k{side}").isNotNull())
    values = alive.groupBy(*by, F.col(f"_b{side}").alias("block"), F.col(f"_k{side}").alias("value")).agg(F.count("*").alias("c"))
    sums = values.groupBy(*by, "block").agg(F.sum("c").alias("c"))
    upto, group = Window.partitionBy(*by).orderBy("block"), Window.partitionBy(*by)
    ranked = sums.withColumns({"end": F.sum("c").over(upto), "rank": F.floor((F.sum("c").over(group) - 1) * F.lit(fraction))})
    holds = ranked.filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c"))).select(
        *by, F.col("block").alias("_at"), (F.col("end") - F.col("c")).alias("_before"), "rank"
    )
    inside = _met(values, holds, by).filter(F.col("block") == F.col("_at"))
    inside = inside.withColumn("end", F.col("_before") + F.sum("c").over(Window.partitionBy(*by).orderBy("value"))).filter(F.col("end") > F.col("rank"))
    found = inside.groupBy(*by).agg(F.min(F.struct("value", "end")).alias("found"))
    rest = F.col("n") - F.coalesce(F.col("found.end"), F.lit(0))
    cut, going = rest >= k, F.col("large")
    met = _met(state, found, by, "left")
    return met.select(
        *by, F.when(going & cut, rest).otherwise(F.col("n")).alias("n"),
        *[(F.when(going & cut & F.col("found").isNotNull(), F.col("found.value")).otherwise(F.col(f"_t{s}")) if s == side else F.col(f"_t{s}")).alias(f"_t{s}") for s in (0, 1)],
        "going", "large", (F.col("whole") & (~going | (cut & (rest < F.col("n"))))).alias("whole"),
    )
