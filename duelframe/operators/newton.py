"""Logistic regression by Newton steps whose sums come from one pass over the rows each; walk-forward Gaussian Bayes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.plans.quantiles import exact_quantiles_of
from duelframe.plans.sizing import cut, small_side


def _plain(name: str, fill: float) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")), F.lit(float(fill)))


@dataclass(frozen=True)
class LogisticFit:
    """Weights on the standardised inputs, with what is needed to standardise others the same way."""

    features: list[str]
    fills: dict[str, float]
    means: list[float]
    scales: list[float]
    weights: list[float]
    bias: float
    steps: int

    def inputs(self) -> list[Column]:
        return [(_plain(f, self.fills[f]) - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.means, self.scales)]

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-_margin(self.inputs(), self.weights, self.bias)))


def _margin(z: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    return reduce(lambda a, b: a + b, [x * F.lit(float(w)) for x, w in zip(z, weights)], F.lit(float(bias)))


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, *, balanced: bool = False, weight: str | None = None, l2: float = 1.0, fills: Mapping[str, float] | None = None, steps: int = 50, tolerance: float = 1e-9,
) -> LogisticFit:
    """Least of sum(weight * log loss) + l2 / 2 * |weights|^2 over inputs with mean 0 and deviation 1; the bias is free.

    Missing inputs take ``fills``, by default the exact medians of ``df``. ``balanced`` weighs both classes alike (rows /
    (2 * class size)); ``weight`` names a column of row weights; rows without a label are left out. Every step reads the
    standardised rows once and brings the sums of the gradient and the second derivatives to the driver: (p + 1)(p + 4) / 2
    numbers for p features, whatever the number of rows. A step that does not lower the objective is halved.
    """
    features = list(features)
    fills = dict(fills) if fills else {f: q[0] or 0.0 for f, q in exact_quantiles_of(df, {f: [0.5] for f in features}).items()}
    rows = df.where(F.col(label).isNotNull())
    x = [_plain(f, fills[f]) for f in features]
    got = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    if not got["pos"] or got["pos"] == got["n"]:
        raise ValueError("both classes are needed")
    means, scales = [got[f"m{i}"] for i in range(len(x))], [got[f"s{i}"] or 1.0 for i in range(len(x))]
    each = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if balanced:
        each = each * F.when(F.col(label) == 1, got["n"] / (2.0 * got["pos"])).otherwise(got["n"] / (2.0 * (got["n"] - got["pos"])))
    table = cut(rows.select((F.col(label) == 1).cast("double").alias("y"), each.alias("s"), *[((c - m) / s).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(x, means, scales))]))
    p = len(x)
    w, last, before, taken = np.zeros(p + 1), None, np.inf, 0
    for taken in range(1, steps + 1):
        value, gradient, second = _sums(table, w, p, l2)
        if last is not None and value > before + 1e-12 * abs(before):
            last = last / 2
            w = w + last  # halve the step that went too far
            continue
        before = value
        last = np.linalg.solve(second, gradient)
        w = w - last
        if np.abs(last).max() < tolerance:
            break
    return LogisticFit(features, fills, means, scales, w[1:].tolist(), float(w[0]), taken)


def _sums(table: DataFrame, w: np.ndarray, p: int, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and second derivatives at the weights (bias first)."""
    z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(p)]]
    pairs = list(combinations_with_replacement(range(p + 1), 2))
    at = table.withColumn("m", _margin(z[1:], w[1:], w[0])).withColumn("q", 1 / (1 + F.exp(-F.col("m"))))
    at = at.withColumns({"g": F.col("s") * (F.col("q") - F.col("y")), "v": F.col("s") * F.col("q") * (1 - F.col("q"))})
    loss = F.greatest(F.col("m"), F.lit(0.0)) - F.col("m") * F.col("y") + F.log1p(F.exp(-F.abs("m")))
    got = at.agg(F.sum(F.col("s") * loss).alias("loss"), *[F.sum(F.col("g") * z[i]).alias(f"g{i}") for i in range(p + 1)], *[F.sum(F.col("v") * z[i] * z[j]).alias(f"h{i}_{j}") for i, j in pairs]).first()
    ridge = np.append(0.0, np.full(p, l2))
    second = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        second[i, j] = second[j, i] = got[f"h{i}_{j}"]
    return got["loss"] + 0.5 * float(ridge @ (w * w)), np.array([got[f"g{i}"] for i in range(p + 1)]) + ridge * w, second + np.diag(ridge + 1e-12)


# ---------------------------------------------------------------- feature search

def score_tests(df: DataFrame, fit: LogisticFit, candidates: Sequence[str], label: str, *, balanced: bool = False, l2: float = 1.0) -> list[tuple[str, float]]:
    """(candidate, score statistic), best first: how fast the fit would improve if the candidate joined it.

    Rao's test needs no fit with the candidate: the gradient at weight 0, against its variance given the features in the fit.
    All candidates share one pass, which adds up p + 3 numbers for each. Missing values take exact medians; a candidate
    that the fit's features already determine scores 0.
    """
    candidates = [c for c in candidates if c not in fit.features]
    if not candidates:
        return []
    fills = {c: q[0] or 0.0 for c, q in exact_quantiles_of(df, {c: [0.5] for c in candidates}).items()}
    rows = df.where(F.col(label).isNotNull())
    x = [_plain(c, fills[c]) for c in candidates]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    each = F.when(F.col(label) == 1, got["n"] / (2.0 * got["pos"])).otherwise(got["n"] / (2.0 * (got["n"] - got["pos"]))) if balanced else F.lit(1.0)
    base, p = [F.lit(1.0), *[F.col(f"b{i}") for i in range(len(fit.features))]], len(fit.features) + 1
    at = rows.select(
        (F.col(label) == 1).cast("double").alias("y"), each.alias("s"), fit.probability().alias("q"), *[c.alias(f"b{i}") for i, c in enumerate(fit.inputs())],
        *[((c - got[f"m{i}"]) / (got[f"s{i}"] or 1.0)).alias(f"c{i}") for i, c in enumerate(x)])
    at = at.withColumns({"g": F.col("s") * (F.col("y") - F.col("q")), "v": F.col("s") * F.col("q") * (1 - F.col("q"))})
    pairs = list(combinations_with_replacement(range(p), 2))
    sums = at.agg(*[F.sum(F.col("v") * base[i] * base[j]).alias(f"h{i}_{j}") for i, j in pairs], *[
        e for k in range(len(x)) for e in (F.sum(F.col("g") * F.col(f"c{k}")).alias(f"u{k}"), F.sum(F.col("v") * F.col(f"c{k}") * F.col(f"c{k}")).alias(f"w{k}"), *[
            F.sum(F.col("v") * F.col(f"c{k}") * base[i]).alias(f"x{k}_{i}") for i in range(p)])]).first()
    inside = np.diag(np.append(1e-12, np.full(p - 1, l2)))
    for i, j in pairs:
        inside[i, j] += sums[f"h{i}_{j}"]
        inside[j, i] = inside[i, j]
    out = []
    for k, name in enumerate(candidates):
        across = np.array([sums[f"x{k}_{i}"] for i in range(p)])
        left = sums[f"w{k}"] - float(across @ np.linalg.solve(inside, across))
        out.append((name, sums[f"u{k}"] ** 2 / left if left > 1e-9 * max(1.0, sums[f"w{k}"]) else 0.0))
    return sorted(out, key=lambda t: (-t[1], t[0]))


def stepwise(
    train: DataFrame, test: DataFrame, start: Sequence[str], candidates: Sequence[str], label: str, *, refit: int = 3, most: int | None = None, min_gain: float = 0.0, **options,
) -> list[dict]:
    """Features joined one by one while the log loss on ``test`` falls by more than ``min_gain``: [{"features", "log_loss"}].

    A step costs one pass over ``train`` for the score tests of all candidates and an exact fit for the ``refit`` best only.
    ``start`` needs at least one feature.
    """
    from duelframe.operators.evaluate import log_loss_term

    tested = {k: options[k] for k in ("balanced", "l2") if k in options}

    def loss(fit: LogisticFit) -> float:
        return test.withColumn("_p", fit.probability()).agg(F.avg(log_loss_term(label, "_p"))).first()[0]

    fit = fit_logistic(train, start, label, **options)
    history = [{"features": list(start), "log_loss": loss(fit)}]
    while len(fit.features) < (most or len(fit.features) + len(candidates)):
        ranked = score_tests(train, fit, candidates, label, **tested)[:refit]
        tries = [(loss(new), name, new) for name, _ in ranked for new in [fit_logistic(train, [*fit.features, name], label, **options)]]
        if not tries or history[-1]["log_loss"] - min(t[0] for t in tries) <= min_gain:
            break
        value, _, fit = min(tries, key=lambda t: t[:2])
        history.append({"features": list(fit.features), "log_loss": value})
    return history


# ---------------------------------------------------------------- walk forward

def walk_forward_bayes(df: DataFrame, features: Sequence[str], label: str, fold: str, out: str = "p", least: int = 30) -> DataFrame:
    """Win probability of every row from the folds before its own, by Gaussian naive Bayes; NULL without enough of them.

    A fold's counts, sums and sums of squares per class are added up once, in one pass; what fold n knows is the running
    total of the folds before it, a table of one row a fold. So all folds are trained and scored in one job. A fold
    is scored when both classes have at least ``least`` rows before it; missing inputs say nothing, and a feature without spread
    before a fold says nothing there.
    """
    features = list(features)
    x = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    per = df.where(F.col(label).isNotNull()).groupBy(fold).agg(*[
        e.alias(f"{n}{c}") for c in (0, 1) for e, n in [(F.count_if(F.col(label) == c), "n"), *[
            item for i, f in enumerate(features) for item in (
                (F.count(F.when(F.col(label) == c, x[f])), f"k{i}_"), (F.sum(F.when(F.col(label) == c, x[f])), f"s{i}_"), (F.sum(F.when(F.col(label) == c, x[f] * x[f])), f"q{i}_"))]]])
    every = df.select(fold).distinct().join(per, fold, "left")
    earlier = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)  # a row a fold
    known = every.select(fold, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("double").alias(c) for c in per.columns if c != fold])
    joined = df.join(small_side(known), fold)
    ready = (F.col("n0") >= least) & (F.col("n1") >= least)

    def term(i: int, c: int) -> Column:
        k, mean = F.col(f"k{i}_{c}"), F.try_divide(F.col(f"s{i}_{c}"), F.col(f"k{i}_{c}"))
        spread = F.try_divide(F.col(f"q{i}_{c}"), k) - mean * mean
        d = x[features[i]] - mean
        return F.when(spread > 1e-9, -0.5 * (F.log(spread) + d * d / spread))

    odds = F.log(F.col("n1")) - F.log(F.col("n0"))
    for i in range(len(features)):
        odds = odds + F.coalesce(term(i, 1) - term(i, 0), F.lit(0.0))
    return joined.withColumn(out, F.when(ready, 1 / (1 + F.exp(-odds)))).select(*df.columns, out)
