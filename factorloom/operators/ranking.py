"""Learning to rank: boosted trees fitted to the pairs of each date by lambda gradients, over partitions.

A date's samples are one list, which stays whole: pairs of its samples with different labels, of which one is among
the TOP by score, pull apart in proportion to what swapping them changes in the list's NDCG (gains 2^label - 1).
Many fits (settings x folds) grow side by side on one read of the lists: a list's row holds its binned features
once and the scores of a block of fits. For each tree and level, tasks add up gradient histograms by (fit, node,
feature, bin), one aggregation brings them together, and only the chosen splits reach the driver. A node of at most
SMALL samples, or any node if the features have at most SMALL combinations of bins, is not split level by level: its
samples, those of equal bins added up, go to one task, which grows the rest of its tree.

Gradients are fixed-point integers (SCALE), so that sums do not depend on how the lists are dealt, and both ways of
growing give the same tree. Scores are written to the shared folder every KEEP trees, or with every tree whose
root is not small; a lost executor costs the passes since.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, kept

BINS = 32
TOP = 30
RIDGE = 1.0
SCALE = 1 << 30  # of gradients as integers
SMALL = 1 << 16  # samples of a node, or sums of samples of equal bins, that one task grows to its end
KEEP = 8  # trees whose scores are worked out again before they are written
CELLS = 1 << 21  # pairs, or histogram cells, that a task holds at once
PIECE = 1 << 15  # pairs that are worked out together
ACCURACY = 10_000  # of the quantiles that bound the bins


def lambdas(score: np.ndarray, label: np.ndarray, there: np.ndarray):
    """First and second derivatives by score of lists (rows), padded where `there` is false."""
    order = np.argsort(np.where(there, -score, np.inf), axis=1, kind="stable")
    take = lambda x: np.take_along_axis(x, order, axis=1)
    s, y, ok = take(score), take(label), take(there)
    worth, top = np.where(ok, 2.0**y - 1, 0.0), min(TOP, s.shape[1])
    discount = 1 / np.log2(np.arange(s.shape[1]) + 2)
    best = (-np.sort(-worth, axis=1) * discount).sum(axis=1)
    pull, bend = np.empty((2, len(s), top, s.shape[1]))
    step = max(1, PIECE // max(1, len(s) * top))
    for at in range(0, s.shape[1], step):
        part = slice(at, at + step)
        higher = y[:, :top, None] - y[:, None, part]
        pair = ok[:, :top, None] & ok[:, None, part] & (higher != 0)
        pair &= np.arange(s.shape[1])[None, None, part] > np.arange(top)[None, :, None]
        change = np.abs((worth[:, :top, None] - worth[:, None, part]) * (discount[None, :top, None] - discount[None, None, part])) / np.maximum(best, 1e-12)[:, None, None]
        sign = np.sign(higher)
        chance = 1 / (1 + np.exp(np.clip(sign * (s[:, :top, None] - s[:, None, part]), -50, 50)))
        pull[..., part], bend[..., part] = np.where(pair, change * chance * sign, 0.0), np.where(pair, change * chance * (1 - chance), 0.0)
    first, second = -pull.sum(axis=1), bend.sum(axis=1)
    first[:, :top] += pull.sum(axis=2)
    second[:, :top] += bend.sum(axis=2)
    back = np.argsort(order, axis=1, kind="stable")
    return np.take_along_axis(first, back, axis=1), np.take_along_axis(second, back, axis=1)


def best_splits(sums: np.ndarray, columns: np.ndarray):
    """(feature, bin) of the best split of each node among some columns, from histograms (nodes, features, BINS,
    [pull, bend, count]) of integers, and the sums left and right of it. Ties go to the first column and bin."""
    g, h = (sums[:, columns][..., k].cumsum(axis=2) / SCALE for k in (0, 1))
    left, right = g[..., :-1] ** 2 / (h[..., :-1] + RIDGE), (g[..., -1:] - g[..., :-1]) ** 2 / (h[..., -1:] - h[..., :-1] + RIDGE)
    at = (left + right).reshape(len(sums), -1).argmax(axis=1)
    feature, cut = columns[at // (BINS - 1)], at % (BINS - 1)
    chosen = sums[np.arange(len(sums)), feature]
    below = np.array([c[: k + 1].sum(axis=0) for c, k in zip(chosen, cut, strict=True)])
    return feature, cut, below, chosen.sum(axis=1) - below


def leaf(sums: np.ndarray) -> np.ndarray:
    """Values of leaves of these sums."""
    return (sums[..., 0] / SCALE) / (sums[..., 1] / SCALE + RIDGE)


def grown(binned: np.ndarray, pull: np.ndarray, bend: np.ndarray, columns: np.ndarray, depth: int):
    """The tree of some samples as features and bins of inner nodes, and values of leaves, each in level order."""
    n, width = len(binned), binned.shape[1]
    node, features, cuts = np.zeros(n, np.int64), [], []
    weights = [pull, bend, np.ones(n, np.int64)]
    for level in range(depth):
        sums = histograms(node, binned, weights, 1 << level)
        feature, cut, below, above = best_splits(sums.reshape(1 << level, width, BINS, 3), columns)
        features.append(feature)
        cuts.append(cut)
        node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
    return np.concatenate(features), np.concatenate(cuts), leaf(np.stack([below, above], axis=1).reshape(-1, 3))


def histograms(node: np.ndarray, binned: np.ndarray, weights: list[np.ndarray], nodes: int) -> np.ndarray:
    """(nodes, features x BINS, weights) sums of integers, exact: parts of them are added as floats below 2^53."""
    width = binned.shape[1]
    cell = (node[:, None] * width + np.arange(width)) * BINS + binned
    return totals(cell.ravel(), weights, nodes * width * BINS, width).reshape(nodes, width * BINS, len(weights))


def totals(cell: np.ndarray, weights: list[np.ndarray], size: int, width: int = 1) -> np.ndarray:
    """(size, weights) sums by cell, of weights that count for `width` cells each."""
    out = np.zeros((size, len(weights)), np.int64)
    for k, weight in enumerate(weights):
        for half in (weight >> 26, weight & ((1 << 26) - 1)) if k < 2 else (weight,):
            found = np.bincount(cell, np.repeat(half.astype(float), width), size).astype(np.int64)
            out[:, k] = out[:, k] * (1 << 26) + found if k < 2 else found
    return out


def merged(binned: np.ndarray, pull: np.ndarray, bend: np.ndarray, bins: tuple[int, ...]):
    """The samples with those of equal bins added up, which grow the same tree."""
    size = int(np.prod(bins))
    if len(binned) <= size:
        return binned, pull, bend
    cell = np.ravel_multi_index(binned.T, bins)
    there = np.flatnonzero(np.bincount(cell, minlength=size))
    sums = totals(cell, [pull, bend], size)[there]
    return np.stack(np.unravel_index(there, bins), axis=1).astype(np.uint8), sums[:, 0], sums[:, 1]


@dataclass
class Tree:
    """Features and bins of inner nodes and values of leaves, in level order; `known` levels of it are there."""

    depth: int
    features: np.ndarray = None
    cuts: np.ndarray = None
    values: np.ndarray = None

    def __post_init__(self):
        if self.features is None:
            self.features, self.cuts = np.zeros((2, (1 << self.depth) - 1), np.int64)
            self.values = np.zeros(1 << self.depth)

    def nodes(self, binned: np.ndarray, levels: int) -> np.ndarray:
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for level in range(levels):
            at = (1 << level) - 1 + node
            node = 2 * node + (binned[rows, self.features[at]] > self.cuts[at])
        return node

    def score(self, binned: np.ndarray) -> np.ndarray:
        return self.values[self.nodes(binned, self.depth)]

    def place(self, level: int, node: int, features: np.ndarray, cuts: np.ndarray, values: np.ndarray) -> None:
        """Puts the tree grown from a node into its place."""
        for below in range(self.depth - level):
            to, at = (1 << (level + below)) - 1 + (node << below), (1 << below) - 1
            self.features[to : to + (1 << below)] = features[at : 2 * at + 1]
            self.cuts[to : to + (1 << below)] = cuts[at : 2 * at + 1]
        self.values[node << (self.depth - level) : (node + 1) << (self.depth - level)] = values


@dataclass(frozen=True)
class Setting:
    """What a fit is grown with. Fits that differ in n_estimators only are one fit, scored after fewer trees."""

    learning_rate: float = 0.1
    max_depth: int = 4
    n_estimators: int = 100
    feature_fraction: float = 1.0
    seed: int = 7

    def columns(self, features: int, tree: int) -> np.ndarray:
        """The features that a tree may split by."""
        order = np.random.default_rng([self.seed, tree]).permutation(features)
        return np.sort(order[: max(1, round(self.feature_fraction * features))])


@dataclass
class LambdaTrees:
    """A fitted ranker: bin edges of the features, and trees."""

    setting: Setting = field(default_factory=Setting)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros(len(x))
        if len(x) and self.trees:
            bins = binned(x, self.edges)
            for tree in self.trees:
                score += self.setting.learning_rate * tree.score(bins)
        return score


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def bin_edges(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Bounds of at most BINS bins of each feature of rows(x), by mergeable quantiles."""
    shares = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], shares, ACCURACY).alias(str(k)) for k in range(features)]).first()
    return [np.unique(np.array(found[str(k)] or [], float)) for k in range(features)]


LISTS = "list string, block int, n int, y binary, bins binary, train binary, test binary, score binary, pull binary, bend binary"


class Fits:
    """Fits of settings x folds on rows(list, symbol, x, y, train, test, …): a row trains the folds of its array `train`
    and is scored in those of `test`; other columns come back with its scores. Rows are shuffled once, by list."""

    def __init__(self, rows: DataFrame, settings: list[Setting], folds: int, features: int, small: int = SMALL):
        self.features, self.folds, self.small = features, folds, small
        distinct: dict[Setting, int] = {}
        self.of = []
        for s in settings:
            width = max(1, round(s.feature_fraction * features))
            key = Setting(s.learning_rate, s.max_depth, 0, width / features, s.seed)
            self.of.append(distinct.setdefault(key, len(distinct)))
        rounds = [max(s.n_estimators for s, k in zip(settings, self.of, strict=True) if k == j) for j in range(len(distinct))]
        self.settings = settings
        self.grown = [Setting(s.learning_rate, s.max_depth, n, s.feature_fraction, s.seed) for s, n in zip(distinct, rounds, strict=True)]
        self.fits = [(j, fold) for fold in range(folds) for j in range(len(self.grown))]
        self.trees: list[list[Tree]] = [[] for _ in self.fits]
        depth = max(s.max_depth for s in self.grown)
        self.block = max(1, CELLS // ((features * BINS * 3) << depth))
        self.edges = bin_edges(rows, features)
        bins = tuple(len(e) + 1 for e in self.edges)
        self.bins = bins if prod(bins) <= small else None  # where sums by all bins are few
        spark = rows.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        first = ["symbol", "x", "y", "train", "test"]
        self.extra = [c for c in rows.columns if c not in (*first, "list")]
        whole = F.sort_array(F.collect_list(F.struct(*first, *self.extra)))
        self.lists = kept(rows.repartition(tasks, "list").groupBy("list").agg(whole.alias("rows")), "lists")
        blocks = F.explode(F.sequence(F.lit(0), F.lit((len(self.fits) - 1) // self.block))).alias("block")
        self.state = kept(self.lists.select("list", blocks, "rows").mapInArrow(_packing(self.edges, folds, features, self.block, len(self.fits)), LISTS), "scores")
        counted = self.lists.select(F.explode("rows.train").alias("train")).select(F.explode("train").alias("fold")).groupBy("fold").count().collect()
        self.sizes = {r["fold"]: r["count"] for r in counted}
        self.since = 0  # trees that the written scores hold

    def run(self, at_count) -> None:
        """Grows all trees; `at_count(n)` is called when n trees are grown that some setting ends with."""
        ends = {s.n_estimators for s in self.settings}
        if 0 in ends:
            at_count(0)
        for tree in range(max(ends)):
            active = [k for k, (j, _) in enumerate(self.fits) if tree < self.grown[j].n_estimators]
            large = any(not self._whole(self.sizes.get(self.fits[k][1], 0)) for k in active)
            if large or tree - self.since >= KEEP:
                self.advance(tree, gradients=large)
            self.grow(tree, active)
            if tree + 1 in ends:
                at_count(tree + 1)

    def _whole(self, n: int) -> bool:
        """Whether one task grows a node of n samples to its end."""
        return n <= self.small or self.bins is not None

    def advance(self, tree: int, gradients: bool = False) -> None:
        """Writes the scores of the trees so far (and the gradients that the next one starts from)."""
        before, self.state = self.state, kept(self.state.mapInArrow(_advancing(self._shared({}, 0, tree), gradients), LISTS), "scores")
        discard(before)
        self.since = tree

    def grow(self, tree: int, active: list[int]) -> None:
        """One more tree of each active fit, a level of all of them at a time."""
        fresh = {k: Tree(self.grown[self.fits[k][0]].max_depth) for k in active}
        waiting = {(k, 0): self.sizes.get(self.fits[k][1], 0) for k in active}
        level = 0
        while waiting := {key: n for key, n in waiting.items() if n}:
            todo: dict[int, dict[int, bool]] = {}
            for (k, node), n in waiting.items():
                todo.setdefault(k, {})[node] = self._whole(n)
            shared = self._shared(todo, level, tree, fresh)
            sums = self.state.mapInArrow(_emitting(shared), "fit int, node int, whole boolean, n int, payload binary")
            tasks = max(1, min(len(waiting), self.state.sparkSession.sparkContext.defaultParallelism))
            found = sums.repartition(tasks, "fit", "node").mapInArrow(_choosing(shared), "fit int, node int, whole boolean, ints binary, values binary").collect()
            waiting = {}
            for r in found:
                k, node, ints = r["fit"], r["node"], np.frombuffer(r["ints"], np.int64)
                if r["whole"]:
                    half = len(ints) // 2
                    fresh[k].place(level, node, ints[:half], ints[half:], np.frombuffer(r["values"]))
                    continue
                at = (1 << level) - 1 + node
                fresh[k].features[at], fresh[k].cuts[at] = ints[:2]
                for side in (0, 1):
                    if level + 1 == fresh[k].depth:
                        fresh[k].values[2 * node + side] = leaf(ints[2 + 3 * side : 5 + 3 * side])
                    else:
                        waiting[k, 2 * node + side] = int(ints[4 + 3 * side])
            level += 1
            shared.unpersist()
        for k in active:
            self.trees[k].append(fresh[k])

    def _shared(self, todo: dict, level: int, tree: int, fresh: dict | None = None):
        """What a pass needs to know: bounded by fits x KEEP trees."""
        past = [trees[self.since :] for trees in self.trees]
        columns = {k: self.grown[self.fits[k][0]].columns(self.features, tree) for k in todo}
        rates = [self.grown[j].learning_rate for j, _ in self.fits]
        value = {
            "todo": todo, "level": level, "past": [_stacked(past[at : at + self.block], rates[at : at + self.block]) for at in range(0, len(past), self.block)],
            "fresh": fresh or {}, "columns": columns,
            "folds": [fold for _, fold in self.fits], "block": self.block, "features": self.features, "bins": self.bins, "stored": not any(past) and self.since == tree,
        }
        return self.state.sparkSession.sparkContext.broadcast(value)

    def scored(self, count: int) -> DataFrame:
        """(setting, fold, list, symbol, y, …, score) of the rows to be scored, for the settings that end with so many trees."""
        self.advance(min(count, max(len(t) for t in self.trees)))
        ending = [s for s, setting in enumerate(self.settings) if setting.n_estimators == count]
        wanted = {k: [s for s in ending if self.of[s] == j] for k, (j, _) in enumerate(self.fits)}
        scores = self.state.mapInArrow(_unpacking(wanted, [fold for _, fold in self.fits], self.block), "setting int, fold int, list string, place array<int>, score array<double>")
        met = scores.join(self.lists, "list").select("setting", "fold", "list", "rows", F.explode(F.arrays_zip("place", "score")).alias("r"))
        row = F.col("rows")[F.col("r.place")]
        return kept(met.select("setting", "fold", "list", *[row[c].alias(c) for c in ("symbol", "y", *self.extra)], F.col("r.score").alias("score")), "scored")

    def model(self, setting: int, fold: int) -> LambdaTrees:
        k = self.fits.index((self.of[setting], fold))
        return LambdaTrees(self.settings[setting], self.edges, self.trees[k][: self.settings[setting].n_estimators])


def _packing(edges, folds: int, features: int, block: int, fits: int):
    def run(batches):
        for batch in batches:
            out = []
            for name, at, rows in zip(*(batch.column(c).to_pylist() for c in ("list", "block", "rows")), strict=True):
                x = np.array([r["x"] for r in rows], float).reshape(-1, features)
                train, test = np.zeros((2, folds, len(rows)), bool)
                for i, r in enumerate(rows):
                    train[r["train"], i] = True
                    test[r["test"], i] = True
                y = np.array([0.0 if r["y"] is None else r["y"] for r in rows])
                score = np.zeros((min(block, fits - at * block), len(rows)))
                out.append({"list": name, "block": at, "n": len(rows), "y": y.tobytes(), "bins": binned(x, edges).tobytes(), "train": train.tobytes(),
                            "test": test.tobytes(), "score": score.tobytes(), "pull": None, "bend": None})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return run


_SCHEMA = pa.schema([("list", pa.string()), ("block", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("y", "bins", "train", "test", "score", "pull", "bend")]])


def _unpacking(wanted: dict, folds: list[int], block: int):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.select(["list", "block", "n", "test", "score"]).to_pylist():
                score = np.frombuffer(row["score"]).reshape(-1, row["n"])
                test = np.frombuffer(row["test"], bool).reshape(-1, row["n"])
                for k, mine in enumerate(score, row["block"] * block):
                    if len(place := np.flatnonzero(test[folds[k]])):
                        out += [(setting, folds[k], row["list"], place, mine[place]) for setting in wanted[k]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["setting", "fold", "list", "place", "score"])

    return run


def _opened(row: dict, features: int):
    n = row["n"]
    return (
        np.frombuffer(row["y"]), np.frombuffer(row["bins"], np.uint8).reshape(n, features), np.frombuffer(row["train"], bool).reshape(-1, n),
        np.frombuffer(row["score"]).reshape(-1, n).copy(),
    )


def _stacked(past: list[list[Tree]], rates: list[float]) -> list[tuple]:
    """The trees of a block's fits that are not written yet, those of one turn and depth side by side."""
    out = []
    for turn in range(max(map(len, past), default=0)):
        depths: dict[int, list[int]] = {}
        for i, trees in enumerate(past):
            if turn < len(trees):
                depths.setdefault(trees[turn].depth, []).append(i)
        for depth, fits in depths.items():
            parts = [np.stack([getattr(past[i][turn], name) for i in fits]) for name in ("features", "cuts", "values")]
            out.append((depth, fits, np.array([rates[i] for i in fits])[:, None], *parts))
    return out


def _replayed(known: dict, block: int, bins: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Scores of a block's fits after the trees that are not written yet."""
    rows = np.arange(len(bins))
    for depth, fits, rates, features, cuts, values in known["past"][block]:
        node = np.zeros((len(fits), len(bins)), np.int64)
        for level in range(depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (bins[rows, np.take_along_axis(features, at, 1)] > np.take_along_axis(cuts, at, 1))
        score[fits] += rates * np.take_along_axis(values, node, 1)
    return score


def _gradients(y: np.ndarray, score: np.ndarray, there: np.ndarray):
    """Gradients of fits (rows) on one list, as integers; as many fits at once as CELLS pairs allow."""
    pull, bend = np.zeros((2, *score.shape), np.int64)
    some = np.flatnonzero(there.any(axis=1))
    step = max(1, CELLS // max(1, min(TOP, len(y)) * len(y)))
    for at in range(0, len(some), step):
        part = some[at : at + step]
        first, second = lambdas(score[part], np.broadcast_to(y, (len(part), len(y))), there[part])
        pull[part], bend[part] = np.rint(first * SCALE), np.rint(second * SCALE)
    return pull, bend


def _advancing(shared, gradients: bool):
    def run(batches):
        known = shared.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                y, bins, train, score = _opened(row, known["features"])
                score = _replayed(known, row["block"], bins, score)
                row |= {"score": score.tobytes(), "pull": None, "bend": None}
                if gradients:
                    folds = known["folds"][row["block"] * known["block"] :][: len(score)]
                    pull, bend = _gradients(y, score, train[folds])
                    row |= {"pull": pull.tobytes(), "bend": bend.tobytes()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return run


_SUMS = pa.schema([("fit", pa.int32()), ("node", pa.int32()), ("whole", pa.bool_()), ("n", pa.int32()), ("payload", pa.binary())])


def _emitting(shared):
    """Of every list and open node: histograms, or the samples of a small one."""

    def run(batches):
        known = shared.value
        features, level, todo = known["features"], known["level"], known["todo"]
        sums: dict[tuple[int, int], np.ndarray] = {}
        rows: dict[tuple[int, int], list] = {}
        held = 0

        def flush():
            out = [(k, node, False, 0, total.tobytes()) for (k, node), total in sums.items()]
            for (k, node), parts in rows.items():
                bins, pull, bend = (np.concatenate(p) for p in zip(*parts, strict=True))
                bins = bins.reshape(-1, features)
                if known["bins"]:
                    bins, pull, bend = merged(bins, pull, bend, known["bins"])
                out.append((k, node, True, bins.size, bins.tobytes() + pull.tobytes() + bend.tobytes()))
            sums.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SUMS.types, strict=True)], schema=_SUMS) if out else None

        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * known["block"]
                y, bins, train, score = _opened(row, features)
                mine = [i for i in range(len(score)) if first + i in todo]
                there = train[[known["folds"][first + i] for i in range(len(score))]]
                if known["stored"] and row["pull"] is not None:
                    pull, bend = (np.frombuffer(row[c], np.int64).reshape(score.shape) for c in ("pull", "bend"))
                else:
                    there[[i for i in range(len(score)) if i not in set(mine)]] = False
                    pull, bend = _gradients(y, _replayed(known, row["block"], bins, score), there)
                for i in mine:
                    k, some = first + i, np.flatnonzero(there[i])
                    if not len(some):
                        continue
                    b, g, h = bins[some], pull[i][some], bend[i][some]
                    node = known["fresh"][k].nodes(b, level)
                    wide = [at for at, small in todo[k].items() if not small]
                    if wide:
                        place = np.full(1 << level, -1)
                        place[wide] = np.arange(len(wide))
                        inside = place[node] >= 0
                        total = histograms(place[node[inside]], b[inside], [g[inside], h[inside], np.ones(inside.sum(), np.int64)], len(wide))
                        for at, part in zip(wide, total, strict=True):
                            sums[k, at] = sums.get((k, at), 0) + part
                        held += total.nbytes
                    for at in (at for at, small in todo[k].items() if small):
                        inside = node == at if level else slice(None)
                        rows.setdefault((k, at), []).append((b[inside].ravel(), g[inside], h[inside]))
                        held += b[inside].nbytes + 2 * g[inside].nbytes
                if held > CELLS * 16 and (found := flush()):
                    held = 0
                    yield found
        if found := flush():
            yield found

    return run


def _choosing(shared):
    """The split of each node from all its histograms, or the rest of the tree from all its samples."""

    def run(batches):
        known = shared.value
        features, level = known["features"], known["level"]
        sums: dict[tuple[int, int], np.ndarray] = {}
        rows: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, payload = (row["fit"], row["node"]), row["payload"]
                if row["whole"]:
                    n, parts = row["n"], rows.setdefault(key, [])
                    parts.append((np.frombuffer(payload, np.uint8, n).reshape(-1, features), np.frombuffer(payload, np.int64, n // features, n),
                                  np.frombuffer(payload, np.int64, n // features, n + 8 * (n // features))))
                    if known["bins"] and sum(len(p[0]) for p in parts) > 2 * SMALL:
                        rows[key] = [merged(*(np.concatenate(p) for p in zip(*parts, strict=True)), known["bins"])]
                else:
                    sums[key] = sums.get(key, 0) + np.frombuffer(payload, np.int64).reshape(-1, 3)
        out = []
        for (k, node), total in sums.items():
            feature, cut, below, above = best_splits(total.reshape(1, features, BINS, 3), known["columns"][k])
            out.append((k, node, False, np.concatenate([feature, cut, below[0], above[0]]).astype(np.int64).tobytes(), b""))
        for (k, node), parts in rows.items():
            samples = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            if known["bins"]:
                samples = merged(*samples, known["bins"])
            tree = grown(*samples, known["columns"][k], known["fresh"][k].depth - level)
            out.append((k, node, True, np.concatenate(tree[:2]).astype(np.int64).tobytes(), tree[2].tobytes()))
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["fit", "node", "whole", "ints", "values"])

    return run
