"""Exact quantiles with linear interpolation for columns of any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.session import max_group_rows


VALUES = 10_000  # the most values of a rank's interval that one task lists


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], limit: int | None = None) -> list[float | None]:
    """Quantiles of one column, NULL values left out."""
    return exact_quantiles_of(df, {column: probs}, limit)[column]


@dataclass
class _Search:
    """Where the value with number ``rank`` of a column lies: ``below`` values come before the open interval (low, high)."""

    column: str
    rank: int
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        v = F.col(self.column).cast("double")
        ok = v.isNotNull()
        ok = ok if self.low is None else ok & (v > self.low)
        ok = ok if self.high is None else ok & (v < self.high)
        return F.when(ok, v)


def exact_quantiles_of(df: DataFrame, wanted: Mapping[str, Sequence[float]], limit: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles of several columns; every pass serves all columns and ranks together.

    One pass counts. A rank whose interval holds at most ``limit`` values is read off the sorted interval, which then fits
    one task. Ranks of larger intervals share two passes a round: approximate quantiles give pivots, and
    counts around the pivots tell which interval, thousands of times smaller, the rank lies in.
    """
    limit = min(limit or VALUES, max_group_rows(df.sparkSession), VALUES)
    df = df.select(*wanted)
    counts = df.agg(*[F.count(c).alias(c) for c in wanted]).first().asDict()
    ranks = {(c, r) for c, probs in wanted.items() if counts[c] for p in probs for r in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))}
    searches = {(c, r): _Search(c, r, counts[c]) for c, r in sorted(ranks)}
    while wide := [s for s in searches.values() if s.value is None and s.size > limit]:
        _narrow(df, wide)
    left = [s for s in searches.values() if s.value is None]
    if left:
        row = df.agg(*[_nth(s).alias(f"q{i}") for i, s in enumerate(left)]).first()
        for i, s in enumerate(left):
            s.value = float(row[f"q{i}"])
    out: dict[str, list[float | None]] = {}
    for c, probs in wanted.items():
        out[c] = [None] * len(probs)
        if counts[c]:
            for i, p in enumerate(probs):
                at = p * (counts[c] - 1)
                low, high = searches[c, math.floor(at)].value, searches[c, math.ceil(at)].value
                out[c][i] = low + (at - math.floor(at)) * (high - low)
    return out


def _nth(s: _Search) -> Column:
    """The value with the search's rank in its interval, which holds at most ``limit`` values."""
    return F.element_at(F.array_sort(F.collect_list(s.inside())), s.rank - s.below + 1)


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    asked = []
    for i, s in enumerate(searches):
        p = (s.rank - s.below) / s.size
        spots = sorted({max(0.0, p - 0.002), p, min(1.0, p + 0.002)})
        asked.append(F.percentile_approx(s.inside(), F.array(*[F.lit(x) for x in spots]), F.lit(10_000)).alias(f"q{i}"))
    pivots = df.agg(*asked).first()
    around = []
    for i, s in enumerate(searches):
        for j, x in enumerate(sorted(set(pivots[f"q{i}"]))):
            v = s.inside()
            around += [F.count_if(v < x).alias(f"lt{i}_{j}"), F.count_if(v <= x).alias(f"le{i}_{j}")]
    counts = df.agg(*around).first()
    for i, s in enumerate(searches):
        k, start, end, low, high = s.rank - s.below, 0, s.size, s.low, s.high
        for j, x in enumerate(sorted(set(pivots[f"q{i}"]))):
            lt, le = counts[f"lt{i}_{j}"], counts[f"le{i}_{j}"]
            if lt <= k < le:
                s.value = float(x)
                break
            if le <= k:
                low, start = x, le
            elif end == s.size:
                high, end = x, lt
        s.low, s.high, s.below, s.size = low, high, s.below + start, end - start
