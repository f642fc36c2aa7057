"""Numeric column helpers: guarded ratios, rounding, ages, probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_round(c: Column | str) -> Column:
    """Cut after the fourth decimal, then round half-even to two."""
    cut = (_c(c) * 10000).cast("bigint") / F.lit(10000.0)
    return F.bround(cut, 2)


def round_doubles(df: DataFrame, scale: int = 2) -> DataFrame:
    """Round every floating column of the frame half-even."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.bround(c, scale).alias(c) if c in floats else F.col(c) for c in df.columns])


def age_years(on: Column | str, born: Column | str) -> Column:
    return F.datediff(_c(on), _c(born)) / F.lit(365.25)


def whole_years(on: Column | str, born: Column | str) -> Column:
    """Completed years, as on a birthday calendar."""
    on, born = _c(on), _c(born)
    had_birthday = (F.month(on) * 100 + F.dayofmonth(on)) >= (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(on) - F.year(born) - F.when(had_birthday, 0).otherwise(1)


def ratio_difference(a: Column | str, b: Column | str) -> Column:
    """a / b - 1."""
    return F.try_divide(_c(a), _c(b)) - 1


def logistic_gap(gap: Column | str, scale: float = 170.0) -> Column:
    """Win probability of a rating gap."""
    return 1 / (1 + F.exp(-_c(gap) / F.lit(scale)))


def softmax_pair(p: Column | str, q: Column | str, temperature: float = 0.5) -> Column:
    """First component of the two-way softmax at the given temperature."""
    a, b = F.exp(_c(p) / F.lit(temperature)), F.exp(_c(q) / F.lit(temperature))
    return a / (a + b)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(c), F.lit(float(low))), F.lit(float(high)))


def symmetric_probability(p_here: Column | str, p_mirrored: Column | str) -> Column:
    """Average the two orientations of one pairing: p(a beats b) and 1 - p(b beats a), normalised to a + b = 1."""
    a = (_c(p_here) + (1 - _c(p_mirrored))) / 2
    b = ((1 - _c(p_here)) + _c(p_mirrored)) / 2
    return a / (a + b)


def confidence_label(p: Column | str) -> Column:
    p = _c(p)
    return (
        F.when(p >= 0.8, "very high").when(p >= 0.6, "high").when(p >= 0.5, "moderate").otherwise("low")
    )


def row_mean(columns: list[str]) -> Column:
    """Mean over several columns of one row, skipping NULL."""
    present = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 0).otherwise(1) for c in columns])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return F.try_divide(total, present.cast("double"))


def missing_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def wilson_bounds(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p, zz = hits / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half
