"""Rating inputs that depend on the match alone, and decay applied when a rating is read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def method_weight(weights: dict[str, float], symmetric_method: bool = False) -> Column:
    """Weight of the way the match ended, first hit in the order KO, SUB, UD, SD, MD.

    A knock-out suffered by side A carries weight 1 unless ``symmetric_method``;
    every other ending counts for either side.
    """
    def hit(*flags: str) -> Column:
        cond = F.lit(False)
        for f in flags:
            cond = cond | (F.coalesce(F.col(f).cast("int"), F.lit(0)) != 0)
        return cond

    ko = ("ko", "kod") if symmetric_method else ("ko",)
    return (
        F.when(hit(*ko), F.lit(weights["ko"]))
        .when(hit("subw", "subwd"), F.lit(weights["sub"]))
        .when(hit("udec", "udecd"), F.lit(weights["udec"]))
        .when(hit("sdec", "sdecd"), F.lit(weights["sdec"]))
        .when(hit("mdec", "mdecd"), F.lit(weights["mdec"]))
        .otherwise(F.lit(1.0))
    )


def weight_modifier(natural: Column | str, opp_natural: Column | str, fought_at: Column | str) -> Column:
    """Discount when the sides' usual classes differ by at least one: max(0.75, 1 - 0.08 |difference|)."""
    gap = F.abs(_c(natural).cast("double") - _c(opp_natural).cast("double"))
    return F.when(_c(fought_at).isNull() | gap.isNull() | (gap < 1), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.75), 1 - 0.08 * gap)
    )


def scheduled_rounds(time_format: Column | str, legacy: bool = False) -> Column:
    """Scheduled rounds of a format such as "3 Rnd (5-5-5)".

    ``legacy`` looks for the digit 5 (then 1) anywhere in the text instead of reading the leading number.
    """
    text = F.lower(F.trim(_c(time_format).cast("string")))
    if legacy:
        return F.when(F.contains(text, F.lit("5")), 5).when(F.contains(text, F.lit("1")), 1).otherwise(3)
    return F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(3))


def round_modifier(finish_round: Column | str, time_format: Column | str, legacy: bool = False) -> Column:
    """Up to 25 % more for an early finish."""
    r, top = _c(finish_round).try_cast("int"), scheduled_rounds(time_format, legacy)
    return F.when(r.isNull() | (r > top), F.lit(1.0)).otherwise(1 + (1 - r / top) * 0.25)


def first_round_bonus(finish_round: Column | str, per_side: float = 1.15) -> Column:
    """Bonus for a first-round finish; both sides see the same round, so it counts twice."""
    return F.when(_c(finish_round).try_cast("int") == 1, F.lit(per_side * per_side)).otherwise(F.lit(1.0))


def title_text(label: Column | str, strict: bool = False, promotion: str | None = None) -> Column:
    """Does the label read like a title match: it says championship, title (or belt unless ``strict``).

    With the name of a ``promotion``, its "champion" counts too.
    """
    text = F.lower(F.coalesce(_c(label), F.lit("")))
    hit = F.lit(False)
    for word in ["championship", "title"] + ([] if strict else ["belt"]):
        hit = hit | F.contains(text, F.lit(word))
    if promotion:
        hit = hit | (F.contains(text, F.lit(promotion.lower())) & F.contains(text, F.lit("champion")))
    return hit


def layoff_decay(
    rating: Column | str,
    days: Column | str,
    *,
    mode: str = "flat",
    factor: float = 0.978,
    threshold: int = 365,
    inclusive: bool = False,
) -> Column:
    """Rating after a break: ``flat`` multiplies once, ``power`` multiplies by factor^(days/365)."""
    rating, days = _c(rating), _c(days)
    away = (days >= threshold) if inclusive else (days > threshold)
    by = F.lit(factor) if mode == "flat" else F.pow(F.lit(factor), days / F.lit(365.0))
    return F.when(away, rating * by).otherwise(rating)
