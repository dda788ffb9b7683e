"""Models, portfolios, the catalogue and the store on cases worked out by hand or by brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import models, ranking, scoring, trimming
from factorloom.operators.cleaning import without_spikes
from factorloom.plans.registry import QUERIES
from factorloom.plans.research_queries import GRID
from factorloom.sources.catalog import Catalog, check_dates
from factorloom.store import PanelStore


def plain_cuts(score: np.ndarray, against: np.ndarray, fraction: float, k: int) -> np.ndarray:
    """What the rounds of cuts must leave of one date. A cut takes the rows up to the fraction-quantile of those
    left, by score or by the antagonist's score from above; a pass makes both, as far as each leaves k rows.
    Passes end with the first in which a cut did not come about. Rows without a score count in no quantile
    and are not cut by it."""
    left, whole = np.arange(len(score)), True
    while whole and len(left):
        for key in (score, -against):
            known = key[left][~np.isnan(key[left])]
            rest = left[~(key[left] <= np.quantile(known, fraction))] if len(known) else left
            whole &= k <= len(rest) < len(left)
            left = rest if len(rest) >= k else left
    return np.isin(np.arange(len(score)), left)


def test_cuts_from_two_sides_equal_one_place(spark):
    rng = np.random.default_rng(4)
    cases = {"same": (np.arange(20.0), np.arange(20.0)[::-1]), "both": (np.arange(20.0), np.arange(20.0)), "few": (np.arange(3.0), np.arange(3.0)), "ties": (np.repeat([1.0, 2.0], 30), np.ones(60)),
             "gone": (np.full(30, np.nan), np.full(30, np.nan)), "big": (rng.normal(size=300), rng.normal(size=300))}
    for d in range(12):
        n = int(rng.integers(1, 150))
        a, b = rng.normal(size=n).round(int(rng.integers(0, 3))), rng.normal(size=n).round(1)
        a[rng.random(n) < 0.1] = np.nan
        cases[f"day{d}"] = (a, b)
    rows = [(None if day == "day3" else day, i, None if i % 2 and np.isnan(x) else float(x), float(y)) for day, (a, b) in cases.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "day string, i int, a double, b double").repartition(4)
    for fraction, k in ((0.1, 16), (0.25, 5)):
        found = {}
        for r in trimming.trimmed(df, ["day"], "a", "b", fraction, k).collect():
            found.setdefault(r.day or "day3", {})[r.i] = r.left
        for day, (a, b) in cases.items():
            assert [found[day][i] for i in range(len(a))] == plain_cuts(a, b, fraction, k).tolist(), (day, fraction)
    assert trimming.trimmed(df.limit(0), ["day"], "a", "b", 0.1, 5).count() == 0


@pytest.mark.parametrize("small", [0, 40, 1 << 16])
def test_cuts_end_in_one_task_of_what_is_left(spark, monkeypatch, small):
    """By rounds only, by rounds first, and by one task for each group; only rounds write tables, and they write fewer rows."""
    rng = np.random.default_rng(6)
    cases = {f"day{d}": (rng.normal(size=n).round(1), rng.normal(size=n).round(2)) for d, n in enumerate((1, 30, 60, 400))}
    cases["gone"] = (np.full(50, np.nan), np.arange(50.0))
    rows = [(None if day == "day2" else day, i, float(x), float(y)) for day, (a, b) in cases.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    written, keep = [], trimming.kept
    monkeypatch.setattr(trimming, "kept", lambda rows, name="kept": (written.append(name), keep(rows, name))[1])
    monkeypatch.setattr(trimming, "SMALL", small)
    found = {}
    for r in trimming.trimmed(spark.createDataFrame(rows, "day string, i int, a double, b double").repartition(4), ["day"], "a", "b", 0.1, 16).collect():
        found.setdefault(r.day or "day2", {})[r.i] = r.left
    for day, (a, b) in cases.items():
        assert [found[day][i] for i in range(len(a))] == plain_cuts(a, b, 0.1, 16).tolist(), day
    assert len(written) == 3 if small > 400 else written.count("placed") > 1 and len(written) > 6


def test_at_most_is_exact(spark):
    rows = spark.range(1000).select(F.lit("2020-01-31").cast("date").alias("timestamp"), F.col("id").cast("string").alias("symbol"))
    for n in (0, 1, 333, 1000, 5000):
        found = [r.symbol for r in models.at_most(rows, n).collect()]
        assert len(found) == min(n, 1000) and sorted(found) == sorted(r.symbol for r in models.at_most(rows.repartition(7), n).collect())
    assert models.subsample(rows, 0.25).count() == 250


def pairwise(score, label):
    """Lambda gradients of one list, pair by pair."""
    order = np.argsort(-score, kind="stable")
    place = np.argsort(order)
    worth, discount = 2.0**label - 1, 1 / np.log2(np.arange(len(score)) + 2)
    best = (np.sort(worth)[::-1] * discount).sum()
    pull = np.zeros(len(score))
    for i in range(len(score)):
        for j in range(len(score)):
            if label[i] > label[j] and min(place[i], place[j]) < ranking.TOP:
                change = abs((worth[i] - worth[j]) * (discount[place[i]] - discount[place[j]])) / best
                force = change / (1 + np.exp(score[i] - score[j]))
                pull[i] += force
                pull[j] -= force
    return pull


def test_lambdas_equal_pairs():
    rng = np.random.default_rng(3)
    score, label, there = rng.normal(size=(3, 50)), rng.integers(0, 4, (3, 50)).astype(float), np.ones((3, 50), bool)
    there[1, 40:] = False
    pull, bend = ranking.lambdas(score, label, there)
    for k in range(3):
        n = there[k].sum()
        assert np.allclose(pull[k, :n], pairwise(score[k, :n], label[k, :n])) and np.all(pull[k, n:] == 0) and np.all(bend >= 0)


def test_ranker_learns_an_order(spark):
    rng = np.random.default_rng(5)
    rows = []
    for day in range(30):
        a, b = rng.normal(size=(2, 40))
        y = np.argsort(np.argsort(a * 2 - b)) * 3 // 40
        rows += [(f"2020-01-{day + 1:02d}", f"s{k}", int(y[k]), float(a[k]), float(b[k]), float(y[k])) for k in range(40)]
    samples = spark.createDataFrame(rows, "timestamp string, symbol string, y int, a double, b double, ret double").withColumn("timestamp", F.to_date("timestamp"))
    found = models.cross_validated(models.BoostedRanker(["a", "b"], n_labels=3, options={"n_estimators": 40}), samples, "ret", 3, k=10).collect()
    assert [r.fold for r in sorted(found)] == [0, 1, 2] and all(r.ndcg > 0.9 and r.mean_return > 1.8 for r in found)
    one = models.BoostedRanker(["a", "b"], n_labels=3).fit(samples)
    other = models.BoostedRanker(["a", "b"], n_labels=3).fit(samples.repartition(5))
    assert [r.score for r in one.predict(samples).collect()] == [r.score for r in other.predict(samples).collect()]


def plain_trees(x, y, lists, setting, edges):
    """The ranker grown in one place from all samples: what fits over partitions must equal."""
    bins, score = ranking.binned(x, edges), np.zeros(len(x))
    model = ranking.LambdaTrees(setting, edges)
    for t in range(setting.n_estimators):
        pull, bend = np.zeros((2, len(x)), np.int64)
        for name in np.unique(lists):
            at = np.flatnonzero(lists == name)
            first, second = ranking.lambdas(score[None, at], y[None, at], np.ones((1, len(at)), bool))
            pull[at], bend[at] = np.rint(first[0] * ranking.SCALE), np.rint(second[0] * ranking.SCALE)
        columns = setting.columns(x.shape[1], t)
        node, splits = np.zeros(len(x), np.int64), []
        for _ in range(setting.max_depth):
            chosen = {}
            for n in np.unique(node):
                mine, best = node == n, None
                for c in columns:
                    for b in range(ranking.BINS - 1):
                        low = mine & (bins[:, c] <= b)
                        parts = [(int(pull[k].sum()) / ranking.SCALE, int(bend[k].sum()) / ranking.SCALE) for k in (low, mine & ~low)]
                        gain = sum(g**2 / (h + ranking.RIDGE) for g, h in parts)
                        if best is None or gain > best[0]:
                            best = (gain, c, b)
                chosen[n] = best[1:]
            splits.append(chosen)
            node = 2 * node + np.array([bins[i, chosen[n][0]] > chosen[n][1] for i, n in enumerate(node)])
        tree = ranking.Tree(setting.max_depth)
        for level, chosen in enumerate(splits):
            for n, (c, b) in chosen.items():
                tree.features[(1 << level) - 1 + n], tree.cuts[(1 << level) - 1 + n] = c, b
        for n in np.unique(node):
            tree.values[n] = ranking.leaf(np.array([pull[node == n].sum(), bend[node == n].sum(), 0]))
        model.trees.append(tree)
        score += setting.learning_rate * tree.values[node]
    return model


@pytest.mark.parametrize("small", [0, 60, 1 << 16])
def test_fits_over_partitions_equal_one_place(spark, monkeypatch, small):
    """By levels only, with small nodes finished by one task, and whole trees by one task; several settings and folds at once."""
    rng = np.random.default_rng(9)
    rows = [(f"2020-01-{d + 1:02d}", f"s{k:02d}", [float(v) for v in rng.normal(size=3)], d % 3) for d in range(9) for k in range(12)]
    rows = [(d, s, x, float(min(3, max(0, round(x[0] - x[1] ** 2 + 1)))), [f for f in range(3) if f != fold], [fold]) for d, s, x, fold in rows]
    df = spark.createDataFrame(rows, "list string, symbol string, x array<double>, y double, train array<int>, test array<int>").repartition(5)
    settings = [ranking.Setting(0.3, 3, n, share) for n in (2, 5) for share in (0.6, 1.0)] + [ranking.Setting(0.1, 2, 4)]
    monkeypatch.setattr(ranking, "KEEP", 3)
    found = []
    fits = ranking.Fits(df, settings, 3, 3, small)
    assert len(fits.grown) == 3  # fewer trees of the same setting are no fit of their own
    fits.run(lambda n: found.extend(fits.scored(n).collect()))
    assert len(found) == len(settings) * len(rows)
    for s, setting in enumerate(settings):
        for fold in range(3):
            mine = sorted(r for r in rows if fold in r[4])
            plain = plain_trees(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), np.array([r[0] for r in mine]), setting, fits.edges)
            held = sorted(r for r in rows if fold in r[5])
            want = dict(zip([(r[0], r[1]) for r in held], plain.predict(np.array([r[2] for r in held])), strict=True))
            got = {(r["list"], r["symbol"]): r["score"] for r in found if r["setting"] == s and r["fold"] == fold}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
            assert fits.model(s, fold).predict(np.array([held[0][2]]))[0] == pytest.approx(want[held[0][:2]], abs=1e-12)


@pytest.mark.parametrize("width", [1, 2])
def test_samples_of_equal_bins_are_added_up(spark, monkeypatch, width):
    """Trees over more samples than one task takes, whose features have few combinations: one pass a tree, no written gradients."""
    rng = np.random.default_rng(11)
    rows = [(f"2020-01-{d + 1:02d}", f"s{k:02d}", [float(v) for v in rng.integers(0, 4, width)], float(rng.integers(0, 4)), [0], [0]) for d in range(9) for k in range(12)]
    df = spark.createDataFrame(rows, "list string, symbol string, x array<double>, y double, train array<int>, test array<int>").repartition(5)
    written, levels, setting = [], [], ranking.Setting(0.3, 3, 5)
    advance, shared = ranking.Fits.advance, ranking.Fits._shared
    monkeypatch.setattr(ranking.Fits, "advance", lambda self, tree, gradients=False: (written.append(gradients), advance(self, tree, gradients))[1])
    monkeypatch.setattr(ranking.Fits, "_shared", lambda self, todo, level, *more: (levels.append(level), shared(self, todo, level, *more))[1])
    fits, found = ranking.Fits(df, [setting], 1, width, 40), []
    fits.run(lambda n: found.extend(fits.scored(n).collect()))
    assert written == [False] and set(levels) == {0}
    rows.sort()
    plain = plain_trees(np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows]), setting, fits.edges)
    want = dict(zip([(r[0], r[1]) for r in rows], plain.predict(np.array([r[2] for r in rows])), strict=True))
    assert {(r["list"], r["symbol"]): r["score"] for r in found} == pytest.approx(want, abs=1e-12)


def test_merged_samples_have_the_same_tree():
    rng = np.random.default_rng(12)
    binned, pull, bend = rng.integers(0, 5, (2000, 3)).astype(np.uint8), rng.integers(-(1 << 40), 1 << 40, 2000), rng.integers(0, 1 << 40, 2000)
    few = ranking.merged(binned, pull, bend, (5, 5, 5))
    assert len(few[0]) == 125 and few[1].sum() == pull.sum() and few[2].sum() == bend.sum()
    for a, b in zip(ranking.grown(binned, pull, bend, np.arange(3), 4), ranking.grown(*few, np.arange(3), 4), strict=True):
        assert a.tolist() == b.tolist()


def test_gradients_in_pieces_equal_those_at_once(monkeypatch):
    rng = np.random.default_rng(13)
    score, label, there = rng.normal(size=(2, 900)).round(1), rng.integers(0, 4, (2, 900)).astype(float), rng.random((2, 900)) < 0.9
    found = ranking.lambdas(score, label, there)
    monkeypatch.setattr(ranking, "PIECE", 1 << 30)
    assert all(np.array_equal(a, b) for a, b in zip(found, ranking.lambdas(score, label, there), strict=True))


def test_sums_of_wide_integers_are_exact():
    weight = np.array([(1 << 45) + 3, -(1 << 44) - 7, 5, -1])
    found = ranking.histograms(np.array([0, 0, 0, 1]), np.array([[1], [1], [2], [0]], np.uint8), [weight, -weight, np.ones(4, np.int64)], 2)
    assert found[0, 1].tolist() == [(1 << 44) - 4, 4 - (1 << 44), 2] and found[1, 0].tolist() == [-1, 1, 1] and found[0, 2].tolist() == [5, -5, 1]


def walk_rows(spark, days=24, n=15):
    rng = np.random.default_rng(1)
    rows = []
    for d in range(days):
        a, b = rng.normal(size=(2, n))
        rows += [(f"2020-{d // 2 + 1:02d}-{10 + d % 2}", f"s{k:02d}", int(y), float(a[k]), float(b[k])) for k, y in enumerate(np.argsort(np.argsort(a)) * 3 // n)]
    return spark.createDataFrame(rows, "timestamp string, symbol string, y int, a double, b double").withColumn("timestamp", F.to_date("timestamp"))


def test_walk_forward_fits_all_folds_as_one_by_one(spark):
    samples = walk_rows(spark)
    intervals = spark.createDataFrame([(0, "train", "2020-01-01", "2020-05-31"), (0, "test", "2020-05-31", "2020-07-31"), (1, "train", "2020-03-01", "2020-08-31"),
                                       (1, "validation", "2020-08-31", "2020-09-30"), (1, "test", "2020-09-30", "2020-12-31")], "fold int, split string, start string, end string")
    intervals = intervals.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    options = {"n_estimators": 5, "max_depth": 2}
    for make in (lambda: models.BoostedRanker(["a", "b"], n_labels=3, options=options),
                 lambda: models.MetaScorer([models.SingleFeature("a")], models.BoostedRanker(["base0"], n_labels=3, options=options)),
                 lambda: models.TrimmedScorer(models.SingleFeature("a"), models.SingleFeature("b"), 0.2, 5)):
        found = models.walk_forward(make(), samples, intervals).collect()
        assert {r.fold for r in found} == {0, 1} and len(found) == (4 + 6) * 15
        for fold, start, end in ((0, "2020-01-01", "2020-05-31"), (1, "2020-03-01", "2020-08-31")):
            one = make().fit(samples.filter((F.col("timestamp") > start) & (F.col("timestamp") <= end)))
            wanted = {(r.timestamp, r.symbol): r.score for r in one.predict(samples).collect()} if not isinstance(one, models.TrimmedScorer) else None
            mine = {(r.timestamp, r.symbol): r.pred for r in found if r.fold == fold}
            if isinstance(one, models.BoostedRanker):  # bins come from all folds' rows: orders agree, up to bins
                a = [mine[k] for k in sorted(mine)]
                b = [wanted[k] for k in sorted(mine)]
                assert np.corrcoef(a, b)[0, 1] > 0.95
            elif wanted is None:
                assert {v for v in mine.values()} > {-1e11}


def test_subsample_of_each_fold_is_exact(spark):
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("fold"), F.when(F.col("id") % 9 == 0, "test").otherwise("train").alias("split"),
                                   F.lit("2020-01-31").cast("date").alias("timestamp"), F.col("id").cast("string").alias("symbol"))
    found = {(r.fold, r.split): r["count"] for r in models.subsample_each(rows, 0.25).groupBy("fold", "split").count().collect()}
    assert found == {(0, "test"): 100, (0, "train"): 50, (1, "train"): 75, (2, "train"): 75}
    again = models.subsample_each(rows.repartition(7), 0.25)
    assert again.exceptAll(models.subsample_each(rows, 0.25)).count() == 0


def test_grid_is_appended_and_resumed(spark, tmp_path):
    rows = [(f"2020-01-{d:02d}", f"s{k}", k % 3, float(k), float(k % 3)) for d in range(1, 11) for k in range(6)]
    samples = spark.createDataFrame(rows, "timestamp string, symbol string, y int, a double, ret double")
    made = []

    def make(**options):
        made.append(options)
        return models.BoostedRanker(["a"], n_labels=3, options=options)

    path = f"file://{tmp_path}/results"
    some = {"learning_rate": [0.1, 1.0], "n_estimators": [2]}
    assert models.grid_search(make, samples, some, "ret", path, 2, 3).count() == 4 and len(made) == 2
    found = models.grid_search(make, samples, some | {"n_estimators": [2, 3]}, "ret", path, 2, 3)
    assert found.count() == 8 and len(made) == 4 and found.select("setting").distinct().count() == 4
    assert np.prod([len(v) for v in GRID.values()]) == 81


def test_least_variance_and_equal_risk_by_hand():
    n = 30
    spread = np.linspace(0.1, 0.5, n)
    least = scoring.least_variance(np.diag(spread**2))
    raw = 1 / spread**2  # without a bound the weights go with 1 / variance: here the bound of 0.05 bites on the calmest
    capped = np.zeros(n, bool)
    while True:
        free = np.where(capped, 0, raw)
        want = np.where(capped, 0.05, free / free.sum() * (1 - 0.05 * capped.sum()))
        if (want <= 0.05 + 1e-12).all():
            break
        capped |= want > 0.05
    assert capped.any() and np.allclose(least, want, atol=1e-9) and abs(least.sum() - 1) < 1e-9
    calm = np.linspace(0.2, 0.25, n)
    assert np.allclose(scoring.equal_risk(np.diag(calm**2)), (1 / calm) / (1 / calm).sum(), atol=1e-6)  # no bound bites: 1 / volatility
    at = scoring.at_volatility(np.full(n, 1 / n), np.diag(calm**2), 0.01)
    assert abs(np.sqrt(at @ np.diag(calm**2) @ at) - 0.01) < 1e-12 and scoring.at_volatility(np.full(n, 1 / n), np.eye(n) * 1e-9, 0.1).sum() == pytest.approx(1)


def factor_model(n, seed, days=63):
    """A covariance of n symbols of three factors, from fewer days than symbols, lifted as the queries lift it."""
    rng = np.random.default_rng(seed)
    r = rng.normal(size=(days, 3)) @ rng.normal(size=(3, n)) * 0.01 + rng.normal(size=(days, n)) * rng.uniform(0.005, 0.03, n)
    return scoring.nearest_covariance(np.cov(r.T) * 252)


@pytest.mark.parametrize("n, seed", [(1, 0), (2, 1), (20, 2), (25, 3), (100, 4), (100, 5)])
def test_weights_meet_their_conditions(n, seed):
    cov = np.atleast_2d(factor_model(n, seed)) if n > 1 else np.array([[0.04]])
    x, high = scoring.least_variance(cov), np.full(n, max(0.05, 1 / n))
    assert abs(x.sum() - 1) < 1e-9 and (x >= -1e-12).all() and (x <= high + 1e-12).all()
    assert scoring.slack(cov @ x, x, np.zeros(n), high) < 1e-6
    low, high = np.full(n, 0.5 / n), np.full(n, 2 / n)
    free = scoring.equal_risk(cov)
    inside = (free > low * 1.0001) & (free < high * 0.9999)
    risk = free * (cov @ free)
    assert abs(free.sum() - 1) < 1e-9 and (not inside.any() or np.ptp(risk[inside]) < 1e-6 * risk.mean())
    assert (risk[free <= low * 1.0001] >= risk[inside].max(initial=0) - 1e-9).all() and (risk[free >= high * 0.9999] <= risk[inside].min(initial=np.inf) + 1e-9).all()
    equal = np.full(n, 1 / n)
    most = float(np.sqrt(equal @ cov @ equal))
    calm = scoring.spread_weights(cov, 1e9, low, high, equal)
    least = float(np.sqrt(calm @ cov @ calm))
    for target in (most * 1.5, (most + least) / 2, least * 0.5):
        x = scoring.equal_risk(cov, target)
        got = float(np.sqrt(x @ cov @ x))
        assert abs(x.sum() - 1) < 1e-9 and (x >= low - 1e-12).all() and (x <= high + 1e-12).all()
        if n > 1 and least * 1.001 < target < most:
            assert got == pytest.approx(target, rel=1e-6)
            pull = np.linalg.lstsq(np.c_[cov @ x, np.ones(n)][(x > low * 1.001) & (x < high * 0.999)], (1 / x)[(x > low * 1.001) & (x < high * 0.999)], rcond=None)[0]
            assert scoring.slack(pull[0] * cov @ x - 1 / x, x, low, high) < 1e-5
        else:
            assert got == pytest.approx(min(max(target, least), most), rel=1e-3)


def test_still_prices_do_not_spoil_a_date(spark):
    still = np.array([[0.04, 0.0, np.nan], [0.0, 0.0, 0.0], [np.nan, 0.0, 0.09]])
    fixed = scoring.nearest_covariance(still)
    assert np.allclose(np.diag(fixed), [0.04, 0, 0.09]) and np.isfinite(fixed[[0, 0, 2], [0, 2, 2]]).all()
    pairs = spark.createDataFrame([("2020-01-31", a, b, float(still[i, j]) if np.isfinite(still[i, j]) else None) for i, a in enumerate("xyz") for j, b in enumerate("xyz")], "date string, a string, b string, cov double")
    for method in ("minvar", "erc"):
        found = scoring.optimised_weights(pairs.withColumn("date", F.to_date("date")), method).collect()
        assert abs(sum(r.weight for r in found) - 1) < 1e-9


def test_covariances_of_segments_equal_those_of_whole_windows(spark):
    rng = np.random.default_rng(3)
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 9) for d in range(1, 29)]
    rows = [(d, s, float(rng.uniform(5, 9)) if rng.random() > 0.1 else None) for d in days for s in "abcde"]
    prices = spark.createDataFrame(rows, "date string, symbol string, price double").withColumn("date", F.to_date("date"))
    chosen = [(f"2020-{m:02d}-28", s) for m in (1, 3, 4, 5, 8) for s in rng.choice(list("abcde"), 3, replace=False)] + [("2020-04-28", "zz"), ("2019-01-31", "a")]
    chosen = spark.createDataFrame(chosen, "date string, symbol string").withColumn("date", F.to_date("date"))
    want = {(r.date, r.a, r.b): r.cov for r in scoring.covariance(scoring.window_returns(prices, chosen)).collect()}
    got = {(r.date, r.a, r.b): r.cov for r in scoring.pairwise_covariance(prices, chosen).collect()}
    assert got.keys() == want.keys() and len(want) > 40 and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert scoring.pairwise_covariance(prices, chosen.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["vol_weights", "portfolio_value", "ratio_summary", "momentum_summary"])
def test_summaries_and_portfolios_read_little(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4


def test_missing_days_fail(spark):
    rows = [("2020-03-31", "a", f"2020-03-{d:02d}", None if d < 12 else 0.1) for d in range(1, 20)]
    returns = spark.createDataFrame(rows, "date string, symbol string, day string, r double").withColumns({"date": F.to_date("date"), "day": F.to_date("day")})
    assert scoring.complete_returns(returns, 12).count() == 19
    with pytest.raises(Exception, match="missing days"):
        scoring.complete_returns(returns).collect()


def test_value_to_the_end_of_the_window(spark):
    days = [f"2020-{m:02d}-{d:02d}" for m in (1, 2, 3, 4) for d in (1, 15, 28)]
    prices = spark.createDataFrame([(d, "a", 1.0 + k) for k, d in enumerate(days)] + [(d, "b", 2.0) for d in days], "date string, symbol string, price double").withColumn("date", F.to_date("date"))
    weights = spark.createDataFrame([("2020-01-31", "a", 0.5), ("2020-01-31", "b", 0.5), ("2020-02-29", "b", 1.0)], "date string, symbol string, weight double").withColumn("date", F.to_date("date"))
    found = {str(r.date): r.value for r in scoring.portfolio_value(weights, prices, 1).collect()}
    assert max(found) == "2020-03-28" and min(found) == "2020-01-28"
    assert found["2020-01-28"] == 1.0 and found["2020-02-15"] == pytest.approx(0.5 * 5 / 3 + 0.5) and found["2020-03-28"] == pytest.approx(0.5 * 6 / 3 + 0.5)
    assert max(str(r.date) for r in scoring.portfolio_value(weights, prices).collect()) == "2020-04-28"


def test_failed_saves_leave_nothing(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/panels")
    good = spark.createDataFrame([("2020-01-31", "a", 1.0)], "date string, symbol string, value double").withColumn("date", F.to_date("date"))
    bad = good.withColumn("value", F.when(F.col("symbol") == "a", F.raise_error(F.lit("no"))).cast("double"))
    assert catalog.save(good, "close", "m") == 0
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            catalog.save(bad, "close", "m")
    with pytest.raises(ValueError, match="csv"):
        catalog.save(good, "close", "m", "csv")
    assert catalog.save(good, "close", "m") == 1 and catalog.metadata().count() == 2


def test_store_loads_saves_and_checks_dates(spark, tmp_path):
    days = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    prices = days.crossJoin(spark.createDataFrame([("a",), ("b",)], "symbol string")).withColumns(
        {"close": F.lit(10.0), "adjusted_close": F.dayofyear("date") + 10.0, "volume": F.when((F.col("symbol") == "b") & (F.col("date") > "2020-03-01"), 0.0).otherwise(5.0)})
    week = days.filter(F.dayofweek("date").between(2, 6))
    catalog = Catalog(spark, f"file://{tmp_path}/panels")
    store = PanelStore(spark, "2020-01-01", week, "2020-12-31", catalog)
    panels = store.load(prices)
    assert {r.symbol for r in store.symbols.collect()} == {"a"} and panels["daily_prices"].count() == 262 and panels["volume"].count() == 12
    assert {r.value for r in panels["volume"].collect()} == {5.0 * n for n in (29, 30, 31)} and store.load(prices) is panels
    store.save()
    again = PanelStore(spark, "2020-01-01", week, "2020-12-31", catalog).load_saved()
    assert sorted(again["close"].collect()) == sorted(panels["close"].collect())
    with pytest.raises(ValueError, match="dates"):
        PanelStore(spark, "2020-01-01", days, "2020-12-31", catalog).load_saved()
    with pytest.raises(ValueError, match="dates"):
        check_dates(panels["daily_prices"], days)
    with pytest.raises(LookupError):
        PanelStore(spark, "2020-01-01", week, "2020-12-31", Catalog(spark, f"file://{tmp_path}/none")).load_saved()


def test_spikes_go_until_none_is_left(spark):
    """Nested spikes: each round uncovers the next."""
    values = [10.0]
    for k in range(60):
        values = [*values, *([10.0 * (1 + k % 2 * 2)] if k % 2 else [10.0])]
    rows = spark.createDataFrame([(f"2020-01-01", k, v) for k, v in enumerate(values)], "d string, k int, adjusted_close double")
    rows = rows.select(F.expr("date_add(to_date(d), k)").alias("date"), F.lit("a").alias("symbol"), "adjusted_close", F.lit(1.0).alias("volume"))
    found = [r.adjusted_close for r in without_spikes(rows).orderBy("date").collect()]
    x = list(values)
    while True:
        spike = [i for i in range(1, len(x) - 1) if min(x[i - 1], x[i + 1]) > 1 and ((x[i] / x[i - 1] < 0.5 and x[i + 1] / x[i] > 1.9) or (x[i] / x[i - 1] > 1.9 and x[i + 1] / x[i] < 0.5))]
        if not spike:
            break
        x = [v for i, v in enumerate(x) if i not in spike]
    assert found == x


def test_spikes_of_many_symbols_equal_rounds_over_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(f"s{s}", k, float(rng.choice([3.0, 3.1, 9.0, 10.0, 27.0, 0.5])), float(rng.random() > 0.05)) for s in range(25) for k in range(60)]
    df = spark.createDataFrame(rows, "symbol string, k int, adjusted_close double, volume double").select(F.expr("date_add(date'2020-01-01', k)").alias("date"), "symbol", "adjusted_close", "volume")
    found = {}
    for r in without_spikes(df.repartition(3)).orderBy("symbol", "date").collect():
        found.setdefault(r.symbol, []).append(r.adjusted_close)
    for s in range(25):
        x = [v for name, _, v, volume in rows if name == f"s{s}" and volume > 0]
        while True:
            spike = [i for i in range(1, len(x) - 1) if min(x[i - 1], x[i + 1]) > 1 and ((x[i] / x[i - 1] < 0.5 and x[i + 1] / x[i] > 1.9) or (x[i] / x[i - 1] > 1.9 and x[i + 1] / x[i] < 0.5))]
            if not spike:
                break
            x = [v for i, v in enumerate(x) if i not in spike]
        assert found[f"s{s}"] == x


def test_two_writers_get_two_versions(spark, tmp_path):
    import threading

    catalog = Catalog(spark, f"file://{tmp_path}/panels")
    panel = spark.createDataFrame([(f"{y}-01-31", "a", float(y)) for y in (2019, 2020, 2021)], "date string, symbol string, value double").withColumn("date", F.to_date("date"))
    found, failed = [], []

    def write(k):
        try:
            for _ in range(2):
                found.append((catalog.save(panel.withColumn("value", F.lit(float(k))), "close", "m", writer=k), k))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(v for v, _ in found) == list(range(6)) and catalog.metadata().count() == 6
    for version, k in found:
        assert {r.value for r in catalog.load("close", version).collect()} == {float(k)} and catalog.load("close", version).columns == ["date", "symbol", "value"]
    before = {r.version: r.extras for r in catalog.metadata().collect()}
    catalog.compact()
    assert {r.version: r.extras for r in catalog.metadata().collect()} == before
    assert len(catalog._rows().inputFiles()) == 1 and catalog.save(panel, "close", "m") == 6


def test_loads_read_the_years_asked_for(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/panels")
    panel = spark.createDataFrame([(f"{y}-{m:02d}-28", "a", float(y)) for y in range(2000, 2010) for m in (1, 6)], "date string, symbol string, value double").withColumn("date", F.to_date("date"))
    catalog.save(panel, "close", "m")
    found = catalog.load("close", start="2003-02-01", end="2005-03-01")
    assert sorted(str(r.date) for r in found.collect()) == ["2003-06-28", "2004-01-28", "2004-06-28", "2005-01-28"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(panel_year" in plan
    assert catalog.load("close").count() == 20 and catalog.load("none", start="2003-01-01") is None
    with pytest.raises(ValueError, match="panel_year"):
        catalog.save(panel.withColumn("panel_year", F.lit(1)), "close", "m")
