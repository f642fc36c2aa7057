"""American odds: conversion, clamping, pay-out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def american_from_probability(p: Column | str) -> Column:
    """Whole American odds of a win probability, NULL outside (0, 1)."""
    p = _c(p)
    odds = F.when(p >= 0.5, -F.bround(p / (1 - p) * 100, 0)).otherwise(F.bround((1 - p) / p * 100, 0))
    return F.when((p > 0) & (p < 1), odds)


def clamp_odds(odds: Column | str) -> Column:
    """American odds never lie strictly between -100 and 100 (0 stays 0)."""
    odds = _c(odds)
    return (
        F.when((odds > 0) & (odds < 100), F.lit(100.0))
        .when((odds < 0) & (odds > -100), F.lit(-100.0))
        .otherwise(odds)
    )


def flat_profit(win: Column | str, odds: Column | str, stake: float = 100.0) -> Column:
    """Profit of one flat stake."""
    win, odds = _c(win), _c(odds)
    paid = F.when(odds > 0, F.lit(stake) * odds / 100).otherwise(F.lit(stake) * F.try_divide(F.lit(100.0), F.abs(odds)))
    return F.when(win == 1, paid).otherwise(F.lit(-float(stake)))
