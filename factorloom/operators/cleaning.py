"""Cleaning of raw daily prices and choice of the universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floored
from ..sources.shared import kept

LEAST_DAYS = 252


def without_spikes(prices: DataFrame, price: str = "adjusted_close", down: float = 0.5, up: float = 1.9, floor: float = 1e-4) -> DataFrame:
    """Rows with volume, less one-day spikes down or up, until none is left.

    Neighbours are the surviving rows. All rows are numbered, and looked at, once. A later round looks only at the rows
    whose neighbour went: each run of removed rows is closed by linking the rows at its ends, and the rows whose links
    changed are kept beside the others. What a round writes follows what was removed; it is a table of its own, so that
    the number of rounds does not grow the plan, and a lost executor costs a read.
    """
    along = Window.partitionBy("symbol").orderBy("date")
    point = F.struct(F.col("_pos").alias("pos"), F.col(price).cast("double").alias("x"))
    rows = kept(prices.filter(F.col("volume") > 0).withColumn("_pos", F.row_number().over(along)), "priced")
    place = Window.partitionBy("symbol").orderBy("_pos")
    linked = kept(rows.select("symbol", "_pos", F.col(price).cast("double").alias("_x"), F.lag(point).over(place).alias("_l"), F.lead(point).over(place).alias("_r")), "linked")
    jump, back = F.try_divide("_x", floored(F.col("_l.x"), floor)), F.try_divide("_r.x", floored(F.col("_x"), floor))
    spike = F.coalesce(((jump < down) & (back > up) | (jump > up) & (back < down)) & (F.col("_l.x") > 1) & (F.col("_r.x") > 1), F.lit(False))
    changed = linked.limit(0)
    gone = kept(linked.filter(spike), "spikes")
    removed = [gone.select("symbol", "_pos")]
    while gone.limit(1).count():
        first = (F.lag("_pos").over(place).isNull() | (F.lag("_pos").over(place) != F.col("_l.pos"))).cast("int")
        runs = gone.withColumn("_first", first).withColumn("_run", F.sum("_first").over(place)).groupBy("symbol", "_run").agg(
            F.min_by("_l", "_pos").alias("_a"), F.max_by("_r", "_pos").alias("_b")
        )
        ends = [(F.col("_a.pos"), F.lit(None).cast(point_type(linked)), F.col("_b")), (F.col("_b.pos"), F.col("_a"), F.lit(None).cast(point_type(linked)))]
        sides = [runs.select("symbol", at.alias("_pos"), left.alias("_nl"), right.alias("_nr")).filter("_pos IS NOT NULL") for at, left, right in ends]
        fresh = sides[0].unionByName(sides[1]).groupBy("symbol", "_pos").agg(F.max("_nl").alias("_nl"), F.max("_nr").alias("_nr"))
        known = linked.join(changed.select("symbol", "_pos"), ["symbol", "_pos"], "left_anti").unionByName(changed)
        looked = kept(fresh.join(known, ["symbol", "_pos"]).select("symbol", "_pos", "_x", F.coalesce("_nl", "_l").alias("_l"), F.coalesce("_nr", "_r").alias("_r")), "looked")
        changed = kept(changed.join(looked.select("symbol", "_pos"), ["symbol", "_pos"], "left_anti").unionByName(looked), "changed")
        gone = kept(looked.filter(spike), "spikes")
        removed.append(gone.select("symbol", "_pos"))
    return rows.join(reduce(DataFrame.unionByName, removed), ["symbol", "_pos"], "left_anti").select(*prices.columns)


def point_type(linked: DataFrame):
    return linked.schema["_l"].dataType


def with_history(panel: DataFrame, field: str, least: int = LEAST_DAYS) -> DataFrame:
    """Rows of the symbols with at least that many values of the field."""
    full = panel.groupBy("symbol").agg(F.count(field).alias("n")).filter(F.col("n") >= least)
    return panel.join(full, "symbol", "left_semi")
