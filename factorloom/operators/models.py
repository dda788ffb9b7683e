"""Scorers of samples, walk-forward fits, cross-validation and grids.

A scorer has fit(samples) and predict(samples): DataFrames in, a DataFrame with a score column out; and
fit_each(placed), which fits it to the training rows of every fold at once and scores all rows of each fold.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import Direction, reversed_labels
from ..sources.catalog import append_results, read_results
from ..sources.shared import kept
from .cross_section import ndcg, top_k_mean
from .dataset import cv_folds, parameter_grid, split
from .ranking import Fits, LambdaTrees, Setting
from .trimming import trimmed


class Scorer:
    direction = Direction.BULL

    def fit(self, samples: DataFrame) -> Scorer:
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_each(self, placed: DataFrame) -> DataFrame:
        """placed(fold, split, …) with the scores of each fold's model; this one learns nothing."""
        return self.predict(placed)

    def clone(self) -> Scorer:
        return copy.deepcopy(self)


@dataclass
class SingleFeature(Scorer):
    """The feature itself, or for the bear direction its negative."""

    feature: str
    direction: Direction = Direction.BULL
    name: str = "score"

    def predict(self, samples):
        return samples.withColumn(self.name, F.col(self.feature) if self.direction == Direction.BULL else -F.col(self.feature))


@dataclass
class RandomScore(Scorer):
    """A seeded order of the samples of each date."""

    seed: int = 0
    name: str = "score"

    def predict(self, samples):
        order = Window.partitionBy("timestamp").orderBy(F.md5(F.concat_ws("|", F.lit(self.seed), F.col("timestamp").cast("string"), "symbol")), "symbol")
        return samples.withColumn(self.name, F.row_number().over(order) - 1)


@dataclass
class BoostedRanker(Scorer):
    """Boosted trees that rank the samples of each date by relevance labels; the bear direction learns them reversed.

    Samples that lack a feature are left out, those that lack a label are scored only."""

    features: list[str]
    direction: Direction = Direction.BULL
    n_labels: int = 5
    options: dict = field(default_factory=dict)
    name: str = "score"
    model: LambdaTrees | None = None

    def _x(self):
        return F.array(*[F.col(f).cast("double") for f in self.features])

    def listed(self, samples: DataFrame, train, test, *extra) -> DataFrame:
        """(list, symbol, x, y, train, test, …) of the samples that have all features; train and test are arrays of folds."""
        y = F.when(~F.isnan(F.col("y").cast("double")), _label(self))
        learnt = F.when(y.isNotNull(), train).otherwise(F.array().cast("array<int>"))
        return samples.dropna(subset=self.features).select(
            F.col("timestamp").cast("string").alias("list"), "symbol", self._x().alias("x"), y.alias("y"), learnt.alias("train"), test.alias("test"), *extra
        )

    def fit(self, samples):
        rows = self.listed(samples, F.array(F.lit(0)), F.array().cast("array<int>"))
        fits = Fits(rows, [Setting(**self.options)], 1, len(self.features))
        fits.run(lambda n: None)
        self.model = fits.model(0, 0)
        return self

    def predict(self, samples):
        model = self.model

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.array(x.tolist(), float)) if len(x) else [], dtype=float)

        return samples.dropna(subset=self.features).withColumn(self.name, score(self._x()))

    def fit_each(self, placed):
        folds = placed.agg(F.max("fold")).first()[0]
        if folds is None:
            return placed.withColumn(self.name, F.lit(None).cast("double"))
        names = [c for c in placed.columns if c not in ("fold", "split")]
        once = placed.groupBy(*names).agg(F.collect_list(F.struct("fold", "split")).alias("places"))
        of = lambda places: F.transform(places, lambda p: p["fold"].cast("int"))
        train = of(F.filter("places", lambda p: p["split"] == "train"))
        rows = self.listed(once, train, of(F.col("places")), F.struct(*names).alias("row"), "places")
        found: list[DataFrame] = []
        fits = Fits(rows, [Setting(**self.options)], folds + 1, len(self.features))
        fits.run(lambda n: found.append(fits.scored(n)))
        mine = found[-1].select("row.*", F.explode(F.filter("places", lambda p: p["fold"] == F.col("fold"))).alias("place"), F.col("score").alias("_score"))
        return mine.select("place.fold", "place.split", *names, F.col("_score").alias(self.name))


def _label(ranker: BoostedRanker):
    y = F.col("y") if ranker.direction == Direction.BULL else reversed_labels(F.col("y"), ranker.n_labels)
    return y.cast("double")


@dataclass
class MetaScorer(Scorer):
    """A scorer on the scores of others."""

    bases: list[Scorer]
    top: Scorer

    def _scores(self, samples, each: bool = False):
        for k, base in enumerate(self.bases):
            samples = (base.fit_each if each else base.predict)(samples).withColumnRenamed("score", f"base{k}")
        return samples

    def fit(self, samples):
        self.bases = [b.fit(samples) for b in self.bases]
        self.top.fit(self._scores(samples))
        return self

    def predict(self, samples):
        return self.top.predict(self._scores(samples))

    def fit_each(self, placed):
        return self.top.fit_each(self._scores(placed, each=True))


@dataclass
class TrimmedScorer(Scorer):
    """A model's scores for what survives an antagonist, date by date; other rows score -1e11."""

    model: Scorer
    antagonist: Scorer
    fraction: float = 0.1
    k: int = 100
    direction: Direction = Direction.BULL

    def predict(self, samples):
        return self._trimmed(self.antagonist.predict(self.model.predict(samples).withColumnRenamed("score", "_a")), ["timestamp"])

    def fit_each(self, placed):
        scored = self.antagonist.fit_each(self.model.fit_each(placed).withColumnRenamed("score", "_a"))
        return self._trimmed(scored, ["fold", "split", "timestamp"])

    def _trimmed(self, rows: DataFrame, by: list[str]) -> DataFrame:
        rows = rows.withColumnRenamed("score", "_against").withColumn("_a", F.col("_a").cast("double"))
        found = trimmed(rows, by, "_a", "_against", self.fraction, self.k)
        return found.withColumn("score", F.when(F.col("left"), F.col("_a")).otherwise(-1e11)).drop("_a", "_against", "left")


def at_most(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n rows of the least hash, exactly and repeatably. Counts of 65,536 ranges of the hash tell which
    ranges are whole; only the one at the border is sorted."""
    order = F.xxhash64(F.lit(seed), "timestamp", "symbol")
    found = rows.groupBy(F.shiftright(order, 48).alias("range")).agg(F.count("*").alias("n")).collect()
    border, room = None, n
    for r in sorted(found):
        if r["n"] > room:
            border = r["range"]
            break
        room -= r["n"]
    if border is None:
        return rows
    marked = rows.withColumn("_order", order)
    edge = marked.filter(F.shiftright("_order", 48) == border).orderBy("_order", "timestamp", "symbol").limit(room)
    return marked.filter(F.shiftright("_order", 48) < border).unionByName(edge).drop("_order")


def subsample(rows: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """That share of the rows, exactly and repeatably, by hash order."""
    return rows if share >= 1 else at_most(rows, int(rows.count() * share), seed)


def subsample_each(placed: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """That share of each fold's training rows, exactly and repeatably, by hash order; other rows stay. Counts of
    65,536 ranges of the hash tell which ranges are whole; only the one at each fold's border is sorted."""
    if share >= 1:
        return placed
    train = placed.filter("split = 'train'").withColumn("_order", F.xxhash64(F.lit(seed), "timestamp", "symbol")).withColumn("_range", F.shiftright("_order", 48))
    sizes = train.groupBy("fold", "_range").agg(F.count("*").alias("_n"))
    upto, whole = Window.partitionBy("fold").orderBy("_range"), Window.partitionBy("fold")
    room = (F.floor(F.sum("_n").over(whole) * share) - (F.sum("_n").over(upto) - F.col("_n"))).alias("_room")
    ranges = kept(sizes.select("fold", "_range", "_n", room).filter("_room > 0"), "ranges")
    met = train.join(ranges, ["fold", "_range"])
    edge = met.filter("_room < _n").withColumn("_place", F.row_number().over(Window.partitionBy("fold", "_range").orderBy("_order", "timestamp", "symbol"))).filter("_place <= _room")
    rest = placed.filter("split <> 'train'")
    return rest.unionByName(met.filter("_room >= _n").select(*placed.columns)).unionByName(edge.select(*placed.columns))


def walk_forward(model: Scorer, samples: DataFrame, intervals: DataFrame, clone: bool = True, share: float = 1.0) -> DataFrame:
    """Predictions (fold, timestamp, symbol, true, pred) of each fold's test rows by a model of its training rows.

    All folds are fitted side by side, each from the start; `clone` leaves the given model untouched."""
    placed = subsample_each(kept(split(samples, intervals), "placed").filter("split in ('train', 'test')"), share)
    found = (model.clone() if clone else model).fit_each(placed).filter("split = 'test'")
    return found.select("fold", "timestamp", "symbol", F.col("y").cast("double").alias("true"), F.col("score").cast("double").alias("pred"))


def cross_validated(ranker: BoostedRanker, samples: DataFrame, returns: str, n_folds: int = 5, k: int = 100) -> DataFrame:
    """(fold, ndcg, mean_return) of a ranker fitted on the other folds, averaged over dates."""
    found: list[DataFrame] = []
    _judged([ranker], kept(samples, "samples"), returns, n_folds, k, found.append)
    return found[0].drop("setting")


def _judged(rankers: list[BoostedRanker], samples: DataFrame, returns: str, n_folds: int, k: int, done) -> None:
    """(fold, ndcg, mean_return, setting) of rankers that differ in their options only, given to `done` for the settings
    that end with the same number of trees, as soon as these are grown. All fits share one read of the samples."""
    one, options = rankers[0], [r.options for r in rankers]
    folds = F.sequence(F.lit(0), F.lit(n_folds - 1))
    placed = cv_folds(samples.dropna(subset=["y", *one.features]), n_folds)
    rows = one.listed(placed, F.array_except(folds, F.array("fold")), F.array("fold"), F.col(returns).cast("double").alias("gain"))
    fits = Fits(rows, [Setting(**o) for o in options], n_folds, len(one.features))
    names = F.array(*[F.lit(json.dumps(o, sort_keys=True)) for o in options])

    def judge(n: int) -> None:
        found = fits.scored(n).withColumn("date", F.struct("setting", "fold", "list"))
        gains, means = ndcg(found, "y", "score", k, n_labels=one.n_labels), top_k_mean(found, "score", "gain", k)
        figures = gains.join(means, "date", "left").groupBy("date.setting", "date.fold").agg(F.avg("ndcg").alias("ndcg"), F.avg("mean").alias("mean_return"))
        done(figures.select("fold", "ndcg", "mean_return", names[F.col("setting")].alias("setting")))

    fits.run(judge)


def grid_search(make, samples: DataFrame, options: dict, returns: str, path: str, n_folds: int = 5, k: int = 100, side_by_side: int = 81) -> DataFrame:
    """(fold, ndcg, mean_return, setting): cross-validation of every setting. So many settings at a time are fitted
    side by side; they are appended to the results at `path` as they are done, and settings that are there
    already are not run again."""
    spark = samples.sparkSession
    append_results(spark.createDataFrame([], RESULTS), path)
    done = {r["setting"] for r in read_results(spark, path, RESULTS).select("setting").distinct().collect()}
    todo = [s for s in parameter_grid(options) if json.dumps(s, sort_keys=True) not in done]
    if todo:
        samples = kept(samples, "samples")
    for at in range(0, len(todo), side_by_side):
        _judged([make(**s) for s in todo[at : at + side_by_side]], samples, returns, n_folds, k, lambda found: append_results(found.coalesce(1), path))
    return read_results(spark, path, RESULTS)


RESULTS = "fold int, ndcg double, mean_return double, setting string"
