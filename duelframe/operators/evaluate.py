"""Scores of predictions as aggregate expressions: one pass each, nothing collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.functions.numbers import logistic_gap, wilson_bounds
from duelframe.operators.profile import auc_by
from duelframe.plans.ordered import ordered_scan
from duelframe.plans.sizing import cut


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_loss_term(label: Column | str, p: Column | str, eps: float = 1e-15) -> Column:
    y, p = _c(label).cast("double"), F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def probability_scores(df: DataFrame, label: str, p: str, keys: Sequence[str] = (), cut: float = 0.5) -> DataFrame:
    """n, accuracy, log loss, mean confidence and AUC."""
    hit = ((F.col(p) > cut).cast("int") == F.col(label).cast("int")).cast("double")
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(log_loss_term(label, p)).alias("log_loss"),
        F.avg(F.greatest(F.col(p), 1 - F.col(p))).alias("avg_confidence"),
    )
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    auc = auc_by(keyed, list(keys) or ["_all"], p, label)
    if keys:
        return base.join(auc, list(keys))
    return base.withColumn("_all", F.lit(0)).join(auc, "_all").drop("_all")


def class_scores(df: DataFrame, label: str, predicted: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with precision, recall, F1, accuracy, PPV, NPV and the 95 % Wilson interval of accuracy."""
    y, h = F.col(label).cast("int"), _c(predicted).cast("int")
    counts = df.groupBy(*keys).agg(
        F.count_if((y == 1) & (h == 1)).alias("tp"), F.count_if((y == 0) & (h == 1)).alias("fp"),
        F.count_if((y == 0) & (h == 0)).alias("tn"), F.count_if((y == 1) & (h == 0)).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    low, high = wilson_bounds(tp + tn, n)
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    return counts.withColumns({
        "accuracy": (tp + tn) / n, "precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn)),
        "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)), "npv": zero(F.try_divide(tn, tn + fn)),
        "wilson_low": low, "wilson_high": high,
    }).withColumn("ppv", F.col("precision"))


def roc_points(df: DataFrame, label: str, score: str, **kw) -> DataFrame:
    """True and false positive rate at every distinct score, highest first."""
    per = df.groupBy(score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.sum(1 - F.col(label).cast("bigint")).alias("_neg")
    ).withColumn("_down", -F.col(score))

    def build(d, w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return d.select("*", F.sum("_pos").over(upto).alias("_tp"), F.sum("_neg").over(upto).alias("_fp"))

    run = ordered_scan(per, [], ["_down"], build, reach=1, sums=["_pos", "_neg"], **kw)
    total = per.agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n")).first()
    rate = lambda c, of: F.col(c) / F.lit(float(of)) if of else F.lit(None).cast("double")
    return run.select(F.col(score).alias("threshold"), rate("_tp", total.p).alias("tpr"), rate("_fp", total.n).alias("fpr"))


def rating_hit(pre: str, opp_pre: str, win: str) -> Column:
    """The higher rated side won; equal ratings count as wrong."""
    return ((F.col(pre) > F.col(opp_pre)) & (F.col(win) == 1)) | ((F.col(pre) < F.col(opp_pre)) & (F.col(win) == 0))


def rating_baseline(df: DataFrame, pre: str, opp_pre: str, win: str, scale: float = 170.0) -> DataFrame:
    """Accuracy, log loss and mean confidence of the rating alone."""
    p = logistic_gap(F.col(pre) - F.col(opp_pre), scale)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(rating_hit(pre, opp_pre, win).cast("double")).alias("accuracy"),
        F.avg(log_loss_term(win, p)).alias("log_loss"), F.avg(F.greatest(p, 1 - p)).alias("avg_confidence"),
    )


def monthly_scores(df: DataFrame, ts: str, label: str, p: str, cut: float = 0.5) -> DataFrame:
    """Precision, recall, F1, AUC and count per month."""
    m = df.withColumn("month", F.date_trunc("month", F.col(ts)).cast("date"))
    scores = class_scores(m, label, F.col(p) > cut, ["month"])
    return scores.join(auc_by(m, ["month"], p, label), "month")


def parity(actual: DataFrame, inferred: DataFrame, label: str, p: str, tolerance: float = 1e-6) -> DataFrame:
    """Metrics with actual and with inferred features side by side, and whether they agree."""
    def one(df, name):
        wide = df.agg(F.avg(((F.col(p) > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"),
                      F.avg(log_loss_term(label, p)).alias("log_loss"))
        return wide.unpivot([], ["accuracy", "log_loss"], "metric", name)

    both = one(actual, "actual").join(one(inferred, "inferred"), "metric")
    return both.withColumn("agree", F.abs(F.col("actual") - F.col("inferred")) <= tolerance)


def confident_slice(df: DataFrame, p: str, at_least: float = 0.7) -> DataFrame:
    return df.where(F.greatest(F.col(p), 1 - F.col(p)) >= at_least)


def recent_rating_score(rated: DataFrame, days: int = 548, scale: float = 170.0) -> DataFrame:
    """Rating baseline over the last ``days`` before the newest match; the rated rows are read twice, so materialised."""
    rated = cut(rated)
    newest = rated.agg(F.max("ts").alias("t")).first().t
    recent = rated.where(F.col("ts") >= F.date_sub(F.lit(newest).cast("date"), days)).where(F.col("score").isNotNull())
    return rating_baseline(recent, "pre", "opp_pre", "score", scale)
