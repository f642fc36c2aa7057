"""Odds tables, outlier filters and return-on-investment back-tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from duelframe.functions.numbers import row_mean
from duelframe.functions.odds import american_from_probability, clamp_odds, flat_profit
from duelframe.operators.clean import within_all
from duelframe.operators.sequence import first_difference, running_totals
from duelframe.plans.quantiles import exact_quantiles
from duelframe.plans.sizing import cut

# Books averaged by default and the hard limits on plausible odds.
BOOKS = ["draftkings_odds", "fanduel_odds", "betmgm_odds", "bovada_odds"]
HARD_HIGH, HARD_LOW = 1300, -1650


def consistent_odds(df: DataFrame, match: Sequence[str], probability: str) -> DataFrame:
    """Normalise the two sides of a match to probability 1 and add clamped American odds.

    Groups by the whole match key, so rematches under one label stay apart;
    matches without exactly two rows keep their raw probability.
    """
    totals = df.groupBy(*match).agg(F.count(F.lit(1)).alias("_n"), F.sum(probability).alias("_sum"))
    norm = F.when(F.col("_n") == 2, F.try_divide(F.col(probability), F.col("_sum"))).otherwise(F.col(probability))
    out = df.join(totals, list(match)).withColumn("prob_norm", norm).drop("_n", "_sum")
    return out.withColumn("odds", clamp_odds(american_from_probability("prob_norm")))


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> tuple[float, float]:
    """Inclusive bounds for ``iqr``; open bounds mean -/+ threshold * std for ``zscore``."""
    if method == "iqr":
        q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
        if q1 is None:
            return (float("-inf"), float("inf"))
        return q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
    if method == "zscore":
        s = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
        if s.m is None or s.s is None:
            return (float("-inf"), float("inf"))
        return s.m - threshold * s.s, s.m + threshold * s.s
    raise ValueError(method)


def filter_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows inside the bounds; rows with a missing value are dropped."""
    low, high = outlier_bounds(df, column, method, threshold)
    c = F.col(column)
    return df.where((c >= low) & (c <= high) if method == "iqr" else (c > low) & (c < high))


def filter_market(df: DataFrame, column: str, books: Sequence[str] = BOOKS, method: str = "iqr", threshold: float = 1.5,
                  allow_missing: bool = False) -> DataFrame:
    """Hard limits over every book, then the statistical filter on what is left."""
    return filter_outliers(within_all(df, books, HARD_LOW, HARD_HIGH, allow_missing), column, method, threshold)


def favourites(df: DataFrame, match: Sequence[str], odds: str, tie: Sequence[str]) -> DataFrame:
    """The row with the lowest odds of every match, combined map-side."""
    rest = [c for c in df.columns if c not in match]
    best = df.where(F.col(odds).isNotNull()).groupBy(*match).agg(
        F.min_by(F.struct(*rest), F.struct(odds, *tie)).alias("_p")
    )
    return best.select(*match, "_p.*").select(*df.columns)


def roi_picks(model: DataFrame, market: DataFrame, *, keys: Sequence[str] = ("DATE", "EVENT", "BOUT", "FIGHTER"),
              match: Sequence[str] = ("DATE", "BOUT"), books: Sequence[str] = BOOKS, odds: str = "odds", win: str = "win",
              side: str = "FIGHTER", stake: float = 100.0, threshold: float = 2.0) -> DataFrame:
    """Join model and market, drop outliers, back the model's favourite of every match and price the bet.

    The joined table is checkpointed: the bounds and the picks both read it. So are the picks, which every running total
    counts, cuts and reads.
    """
    joined = model.select(*keys, odds).join(market.select(*keys, win, *books), list(keys))
    priced = cut(joined.withColumn("avg_market_odds", row_mean(list(books))))
    kept = filter_market(priced, "avg_market_odds", books, "iqr", threshold)
    picks = favourites(kept, match, odds, [side]).withColumn("avg_market_odds", clamp_odds("avg_market_odds"))
    return cut(picks.withColumns({"stake": F.lit(float(stake)), "profit": flat_profit(win, "avg_market_odds", stake)}))


def cumulative_roi(picks: DataFrame, order: Sequence[str], **kw) -> DataFrame:
    """Running profit, stake and return in time order."""
    run = running_totals(picks, list(order), ["profit", "stake"], **kw)
    return run.withColumn("cum_roi", F.try_divide(F.col("cum_profit"), F.col("cum_stake")))


def roi_volatility(cumulative: DataFrame, order: Sequence[str], roi: str = "cum_roi", **kw) -> DataFrame:
    """Final return and mean absolute change of the running return."""
    steps = first_difference(cut(cumulative.select(*order, roi)), [], list(order), roi, "_step", **kw)
    n = F.count(F.lit(1))
    return steps.agg(
        F.max_by(roi, F.struct(*order)).alias("final_roi"),
        F.when(n > 1, F.sum(F.abs("_step")) / (n - 1)).otherwise(F.lit(0.0)).alias("volatility"),
    )


def profit_by(picks: DataFrame, key, name: str) -> DataFrame:
    return picks.groupBy(key.alias(name)).agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("bets"))


def best_period(picks: DataFrame, key, name: str) -> DataFrame:
    """The period with the largest profit (the latest on a tie)."""
    return profit_by(picks, key, name).agg(
        F.max_by(name, F.struct("profit", name)).alias(name), F.max("profit").alias("profit"),
        F.max_by("bets", F.struct("profit", name)).alias("bets"),
    )
