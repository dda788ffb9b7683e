"""Portfolios of the best symbols: selection, covariance, weights, value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..functions.calendar import month_end, month_ends_ahead
from ..functions.scalar import floored
from ..sources.shared import kept
from .cross_section import top_k
from .panel import asof

RISK_FREE = "RISK_FREE"
DAYS = 91
YEAR = 252


def selected(rows: DataFrame, score: str, k: int = 100) -> DataFrame:
    """(date, symbol, slot) of the k best of each date, dated by its month's end."""
    return top_k(rows, score, k).select(month_end(F.col("date")).alias("date"), "symbol", "slot")


def window_returns(prices: DataFrame, chosen: DataFrame, days: int = DAYS, floor: float = 1e-6) -> DataFrame:
    """Log returns (date, symbol, day, r) of the chosen symbols over the `days` days to each date.

    A selection meets only the prices of the months that its window touches."""
    months = F.sequence(F.trunc(F.date_sub("date", days), "month"), F.trunc("date", "month"), F.expr("interval 1 month"))
    asked = chosen.select("date", "symbol", F.explode(months).alias("month"))
    priced = prices.select("symbol", F.col("date").alias("day"), "price", F.trunc("date", "month").alias("month"))
    rows = asked.join(priced, ["symbol", "month"]).filter((F.col("day") >= F.date_sub("date", days)) & (F.col("day") <= F.col("date")))
    along = Window.partitionBy("date", "symbol").orderBy("day")
    now, before = floored(F.col("price"), floor), floored(F.lag("price").over(along), floor)
    first = F.row_number().over(along) == 1
    return rows.select("date", "symbol", "day", F.ln(now / before).alias("r"), first.alias("first")).filter("NOT first").drop("first")


def complete_returns(returns: DataFrame, most_missing: int = 10) -> DataFrame:
    """The returns; the query fails where a chosen symbol lacks `most_missing` or more of a date's days."""
    gaps = F.count(F.when(F.col("r").isNull(), 1)).over(Window.partitionBy("date", "symbol"))
    ok = F.when(gaps < most_missing, F.col("date")).otherwise(F.raise_error(F.lit("too many missing days")).cast("date"))
    return returns.withColumn("date", ok)


def covariance(returns: DataFrame) -> DataFrame:
    """(date, a, b, cov) of all pairs of a date's symbols over common days, annualised."""
    left = returns.select("date", "day", F.col("symbol").alias("a"), F.col("r").alias("ra"))
    right = returns.select("date", "day", F.col("symbol").alias("b"), F.col("r").alias("rb"))
    both = left.join(right, ["date", "day"]).filter("ra IS NOT NULL AND rb IS NOT NULL")
    return both.groupBy("date", "a", "b").agg((F.covar_samp("ra", "rb") * YEAR).alias("cov"))


def pairwise_covariance(prices: DataFrame, chosen: DataFrame, days: int = DAYS, floor: float = 1e-6) -> DataFrame:
    """(date, a, b, cov) of all pairs of a date's chosen symbols over the common days of the `days` days to it, annualised.

    The dates' windows begin and end at few days, which cut time into segments. Each price is read once: counts, sums and
    co-moments are added up by (segment, pair) for the pairs that some window asks for, and a window is the
    sum of its segments. A return belongs to its day, and a window to the days after its first with a price.
    """
    chosen = kept(chosen.select("date", "symbol").distinct(), "chosen")
    along = Window.partitionBy("symbol").orderBy("day")
    price = floored(F.col("price"), floor)
    rows = prices.select("symbol", F.col("date").alias("day"), "price").withColumn("r", F.ln(price / floored(F.lag("price").over(along), floor)))
    calendar = prices.select(F.col("date").alias("day")).distinct()
    dates = chosen.select("date").distinct()
    spans = calendar.join(F.broadcast(dates), (F.col("day") >= F.date_sub("date", days)) & (F.col("day") <= F.col("date")))
    spans = kept(spans.groupBy("date").agg(F.min("day").alias("first")), "spans")  # a return of the first day looks back beyond the window
    cuts = spans.select(F.col("first").alias("cut")).unionByName(spans.select(F.col("date").alias("cut"))).distinct()
    segments = kept(cuts.select("cut", F.lead("cut").over(Window.orderBy("cut")).alias("until")).filter("until IS NOT NULL"), "segments")
    parts = kept(spans.join(F.broadcast(segments), (F.col("cut") >= F.col("first")) & (F.col("until") <= F.col("date"))).select("date", "cut"), "parts")
    of = kept(
        chosen.join(parts, "date").select("cut", "symbol").distinct().join(F.broadcast(segments), "cut"), "asked"
    )
    met = kept(
        rows.filter("r IS NOT NULL").join(F.broadcast(segments), (F.col("day") > F.col("cut")) & (F.col("day") <= F.col("until"))).select("cut", "symbol", "day", "r")
        .join(of.select("cut", "symbol"), ["cut", "symbol"], "left_semi"), "returns"
    )
    asked = chosen.select("date", F.col("symbol").alias("a")).join(chosen.select("date", F.col("symbol").alias("b")), "date").join(parts, "date")
    pairs = kept(asked, "pairs")
    left = met.select("cut", "day", F.col("symbol").alias("a"), F.col("r").alias("x"))
    right = met.select("cut", "day", F.col("symbol").alias("b"), F.col("r").alias("y"))
    moments = left.join(right, ["cut", "day"]).join(pairs.select("cut", "a", "b").distinct(), ["cut", "a", "b"], "left_semi").groupBy("cut", "a", "b").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy")
    )
    total = pairs.join(moments, ["cut", "a", "b"]).groupBy("date", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    cov = F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1) * YEAR)
    return total.select("date", "a", "b", cov.alias("cov"))


def nearest_covariance(matrix: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """The correlation's eigenvalues lifted to `least`, at the same variances.

    Symbols without any spread, or without a variance, stay as they are; an unknown covariance of two others is taken for 0."""
    moves = np.nan_to_num(np.diag(matrix)) > 0
    if not moves.all():
        out = np.array(matrix, float)
        if moves.any():
            out[np.ix_(moves, moves)] = nearest_covariance(np.nan_to_num(matrix[np.ix_(moves, moves)]), least)
        return out
    spread = np.sqrt(np.diag(matrix))
    values, vectors = np.linalg.eigh(matrix / np.outer(spread, spread))
    lifted = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(lifted))
    return lifted * np.outer(scale, scale) * np.outer(spread, spread)


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot(index="a", columns="b", values="cov").sort_index().sort_index(axis=1)


def repaired_covariance(pairs: DataFrame) -> DataFrame:
    """The pairs of each date as a positive definite matrix (a date's selection is bounded by k)."""

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(pdf)
        fixed = pd.DataFrame(nearest_covariance(matrix.to_numpy()), matrix.index, matrix.columns)
        out = fixed.rename_axis(index="a", columns="b").stack().rename("cov").reset_index()
        return out.assign(date=pdf["date"].iloc[0])[["date", "a", "b", "cov"]]

    return pairs.groupBy("date").applyInPandas(repair, "date date, a string, b string, cov double")


def equal_weights(chosen: DataFrame, k: int) -> DataFrame:
    return chosen.select("date", "symbol", F.lit(1.0 / k).alias("weight"))


def volatility_weights(pairs: DataFrame, k: int, target: float = 0.15, least: float = 0.04) -> DataFrame:
    """Weights by inverse volatility, scaled to the target; what is left of 1 is risk-free."""
    pairs = kept(pairs, "pairs")
    start = pairs.filter("a = b").select("date", F.col("a").alias("symbol"), (target / (k * floored(F.sqrt("cov"), least))).alias("w0"))
    left = start.select("date", F.col("symbol").alias("a"), F.col("w0").alias("wa"))
    right = start.select("date", F.col("symbol").alias("b"), F.col("w0").alias("wb"))
    total = pairs.join(left, ["date", "a"]).join(right, ["date", "b"]).groupBy("date").agg(F.sqrt(F.sum(F.col("wa") * F.col("cov") * F.col("wb"))).alias("vol"))
    scaled = start.join(total, "date").withColumn("w", F.col("w0") * target / F.col("vol"))
    sums = F.sum("w").over(Window.partitionBy("date"))
    capped = kept(scaled.withColumn("weight", F.when(sums > 1, F.col("w") / sums).otherwise(F.col("w"))).select("date", "symbol", "weight"), "capped")
    rest = capped.groupBy("date").agg(F.greatest(F.lit(0.0), 1 - F.sum("weight")).alias("weight")).select("date", F.lit(RISK_FREE).alias("symbol"), "weight")
    return capped.unionByName(rest)


TOLERANCE = 1e-9  # of the conditions that end a search, in units of the largest gradient


def slack(gradient: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """How far weights are from the conditions of a least value on {sum = 1, low <= x <= high}, relative to the gradient:
    of two weights, one of which could grow and the other shrink, the one that could grow must not be the better one."""
    edge = 1e-9 * np.maximum(1.0, np.abs(high))
    grows, shrinks = x < high - edge, x > low + edge
    if not grows.any() or not shrinks.any():
        return 0.0
    return max(0.0, float(gradient[shrinks].max() - gradient[grows].min())) / max(float(np.abs(gradient).max()), 1e-300)


def least_quadratic(h: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least of x'Hx / 2 + c'x over sum x = 1 and bounds, from a feasible start: a step solves the free weights exactly,
    as far as the first bound; at the end of a step the bound that hinders most is let go. H is positive definite."""
    x, n, size = start.copy(), len(start), max(float(np.abs(h).max()), 1e-300)
    h, c = h / size, c / size
    free = (x > low) & (x < high)
    for _ in range(50 * n + 50):
        gradient = h @ x + c
        step = np.zeros(n)
        if (m := int(free.sum())) > 1:
            kkt = np.zeros((m + 1, m + 1))
            kkt[:m, :m], kkt[m, :m], kkt[:m, m] = h[np.ix_(free, free)], 1, 1
            step[free] = np.linalg.lstsq(kkt, np.r_[-gradient[free], 0], rcond=None)[0][:m]
        if np.abs(step).max() > 1e-13:
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (high - x) / step, np.where(step < 0, (low - x) / step, np.inf))
            first = int(np.argmin(room))
            if room[first] < 1:
                x = np.clip(x + max(0.0, room[first]) * step, low, high)
                x[first], free[first] = (high if step[first] > 0 else low)[first], False
                continue
            x = np.clip(x + step, low, high)
            gradient = h @ x + c
        level = gradient[free].mean() if free.any() else None
        gain = np.where(free, 0.0, np.where(x <= low, -gradient, gradient))  # of letting a bound go, but for the level
        if level is None:
            up, down = int(np.argmin(np.where(x <= low, gradient, np.inf))), int(np.argmax(np.where(x >= high, gradient, -np.inf)))
            if not (x[up] <= low[up] and x[down] >= high[down] and gradient[up] < gradient[down] * (1 - TOLERANCE)):
                return x
            free[[up, down]] = True
            continue
        gain = np.where(free, -np.inf, gain + np.where(x <= low, level, -level))
        worst = int(np.argmax(gain))
        if gain[worst] <= TOLERANCE * max(np.abs(gradient).max(), 1e-300):
            return x
        free[worst] = True
    raise ArithmeticError("no least weights were found")


def least_variance(cov: np.ndarray, high: float = 0.05) -> np.ndarray:
    """Weights of least variance, none above `high` (or 1/n, if that is more)."""
    n = len(cov)
    size = max(float(np.trace(cov)) / n, 1e-300)
    bound = np.full(n, max(high, 1 / n))
    return least_quadratic(cov / size + 1e-12 * np.eye(n), np.zeros(n), np.zeros(n), bound, np.full(n, 1 / n))


def spread_weights(cov: np.ndarray, pull: float, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least of pull * x'Cx / 2 - sum ln x over sum x = 1 and bounds, by Newton steps inside the bounds."""
    value = lambda x: pull * x @ cov @ x / 2 - np.log(x).sum()
    x = start
    for _ in range(100):
        gradient, bend = pull * cov @ x - 1 / x, pull * cov + np.diag(1 / x**2)
        if slack(gradient, x, low, high) < TOLERANCE:
            break
        step = least_quadratic(bend, gradient - bend @ x, low, high, x) - x
        if (worth := gradient @ step) > -1e-15:
            break
        size = 1.0
        while value(x + size * step) > value(x) + size * worth / 4 and size > 1e-6:
            size /= 2
        x = x + size * step
    return x


def equal_risk(cov: np.ndarray, target: float | None = None) -> np.ndarray:
    """Weights of sum 1 between half and twice 1/n with as equal shares of risk as may be.

    They are least for a pull between x'Cx / 2 and - sum ln x, whose balance makes x (Cx) equal where no bound bites. Without a target
    the pull is the one at which the unit sum costs nothing. With a target volatility, the
    pull is the one whose weights have it; a target that no pull reaches gives the nearest: equal weights, or the least variance.
    """
    n = len(cov)
    low, high = np.full(n, 0.5 / n), np.full(n, 2 / n)
    size = max(float(np.trace(cov)) / n, 1e-300)
    c, goal = cov / size, None if target is None else target**2 / size
    x = np.full(n, 1 / n)
    if goal is not None and x @ c @ x <= goal:
        return x
    bottom, top = 0.0, 1.0

    def over(pull: float, x: np.ndarray) -> bool:
        """Whether the pull is too small."""
        if goal is not None:
            return x @ c @ x > goal
        inside = (x > low * (1 + 1e-9)) & (x < high * (1 - 1e-9))
        price = (1 / x - pull * c @ x)[inside]  # of the unit sum
        return price.mean() > 0 if len(price) else pull * (x @ c @ x) < n

    x = spread_weights(c, top, low, high, x)
    while over(top, x) and top < 1e12:
        bottom, top = top, 8 * top
        x = spread_weights(c, top, low, high, x)
    for _ in range(80):
        if top - bottom <= 1e-10 * top:
            break
        middle = (top + bottom) / 2 if bottom < top / 8 else np.sqrt(top * bottom)
        x = spread_weights(c, middle, low, high, x)
        bottom, top = (middle, top) if over(middle, x) else (bottom, middle)
    return x


def at_volatility(weights: np.ndarray, cov: np.ndarray, target: float) -> np.ndarray:
    """The weights scaled to a volatility, but to a sum of 1 at most."""
    risk = np.sqrt(max(float(weights @ cov @ weights), 0.0))
    return weights * min(1.0, target / risk) if risk > 0 else weights


def optimised_weights(pairs: DataFrame, method: str, target: float | None = None, constrained: bool = False) -> DataFrame:
    """minvar or erc weights of each date's symbols. erc with a target volatility is scaled to it, and what is left is
    risk-free; or, constrained, has it as a condition beside the sum of 1."""
    if method not in ("minvar", "erc"):
        raise ValueError(f"unknown weighting {method!r}")

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(pdf)
        cov = np.nan_to_num(nearest_covariance(matrix.to_numpy()))
        found = least_variance(cov) if method == "minvar" else equal_risk(cov, target if constrained else None)
        rest = method == "erc" and target is not None and not constrained
        found, symbols = (at_volatility(found, cov, target) if rest else found), list(matrix.index)
        if rest:
            found, symbols = [*found, max(0.0, 1 - found.sum())], [*symbols, RISK_FREE]
        return pd.DataFrame({"date": pdf["date"].iloc[0], "symbol": symbols, "weight": found})

    return pairs.groupBy("date").applyInPandas(weigh, "date date, symbol string, weight double")


def blended(weights: DataFrame, window: int) -> DataFrame:
    """Each selection held for `window` month ends; overlaps add up and each date sums to 1."""
    held = weights.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).select(month_ends_ahead(F.col("date"), F.col("j")).alias("date"), "symbol", "weight")
    summed = held.groupBy("date", "symbol").agg(F.sum("weight").alias("weight"))
    return summed.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("date"))))


def with_risk_free(prices: DataFrame, returns: DataFrame) -> DataFrame:
    """prices with the cumulated risk-free return as a symbol of its own."""
    along = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return prices.select("date", "symbol", "price").unionByName(returns.select("date", F.lit(RISK_FREE).alias("symbol"), w.growth(F.coalesce("value", F.lit(0.0)), along).alias("price")))


def portfolio_value(weights: DataFrame, prices: DataFrame, months: int | None = None) -> DataFrame:
    """(date, value) of 1.0 put into the weights and traded at each of their dates, to the last price, or to
    that of `months` month ends after the last weights.

    Weights trade on the last price date at or before their own; gaps in prices are filled forward.
    Each price day bears the trade that it follows, so that weights meet only the prices of their period.
    """
    weights = kept(weights.select("date", "symbol", "weight"), "weights")
    filled = kept(prices.select("date", "symbol", w.fill_forward(F.col("price")).alias("price")), "filled")
    days = kept(filled.select("date").distinct(), "days")
    placed = asof(days.select("date", F.col("date").alias("value")), weights.select("date").distinct()).filter("value IS NOT NULL")
    placed = kept(placed.groupBy("value").agg(F.max("date").alias("date")), "placed")  # of several dates of a trading day the last holds
    trades = weights.join(placed, "date").select(F.col("value").alias("traded"), "symbol", "weight")
    if months is not None:
        end = weights.agg(month_ends_ahead(F.max("date"), months).alias("end"))
        filled = filled.join(F.broadcast(end), F.col("date") <= F.col("end")).drop("end")
    marks = placed.select(F.col("value").alias("traded"))
    ends = marks.withColumn("until", F.lead("traded").over(Window.orderBy("traded")))
    opened = asof(marks.select(F.col("traded").alias("date"), F.col("traded").alias("value")), days).filter("value IS NOT NULL")
    closing = ends.filter("until IS NOT NULL").select(F.col("until").alias("date"), F.col("traded").alias("value"))
    periods = kept(opened.unionByName(closing).withColumnRenamed("value", "traded"), "periods")  # a trading day ends one period and opens another
    at = filled.select(F.col("date").alias("traded"), "symbol", F.col("price").alias("start"))
    held = filled.join(periods, "date").join(trades.join(at, ["traded", "symbol"]), ["traded", "symbol"])
    inside = kept(held.groupBy("traded", "date").agg(F.sum(F.col("weight") * F.try_divide("price", "start")).alias("gain")).join(ends, "traded"), "gains")
    whole = inside.filter("date = until").select("traded", F.col("gain").alias("period"))
    before = marks.join(whole, "traded", "left").withColumn(
        "level", F.coalesce(F.product("period").over(Window.orderBy("traded").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    )
    valued = inside.filter("until IS NULL OR date < until").join(before.select("traded", "level"), "traded")
    return valued.select("date", (F.col("level") * F.col("gain")).alias("value"))


def checked_weights(weights: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The weights; the query fails where those of a date do not sum to 1."""
    total = F.sum("weight").over(Window.partitionBy("date"))
    ok = F.when(F.abs(total - 1) <= tolerance, F.col("weight")).otherwise(F.raise_error(F.lit("weights must sum to 1")).cast("double"))
    return weights.withColumn("weight", ok)
