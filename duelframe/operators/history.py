"""Career, last-3 and last-5 features before and after every match, from a metric list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from duelframe.plans.ordered import ordered_scan


@dataclass(frozen=True)
class Frame:
    """Rows of an entity's history a feature looks at; ``post`` frames include the current match."""

    prefix: str
    suffix: str
    start: int | None
    end: int

    def over(self, w):
        return w.rowsBetween(Window.unboundedPreceding if self.start is None else self.start, self.end)


FRAMES = (
    Frame("postcomp_", "", None, 0),
    Frame("precomp_", "", None, -1),
    Frame("postcomp_", "3", -2, 0),
    Frame("precomp_", "3", -3, -1),
    Frame("postcomp_", "5", -4, 0),
    Frame("precomp_", "5", -5, -1),
)


@dataclass(frozen=True)
class Metric:
    """One feature family.

    kind: sum, avg, count, rate (num * scale / den) or one_minus_ratio (1 - num / den).
    """

    name: str
    kind: str
    num: str = ""
    den: str = ""
    scale: float = 1.0
    sep: str = ""
    frames: tuple[str, ...] = ("", "3", "5")
    sides: tuple[str, ...] = ("precomp_", "postcomp_")
    post_default: float = 0.0
    as_name: str = ""

    def column(self, f: Frame) -> str:
        if self.as_name:
            return f"{f.prefix}{self.as_name}"
        return f"{f.prefix}{self.name}{self.sep if f.suffix else ''}{f.suffix}"

    def wanted(self, f: Frame) -> bool:
        return f.suffix in self.frames and f.prefix in self.sides


def sum_and_avg(*names: str) -> list[Metric]:
    out = []
    for n in names:
        out += [Metric(f"{n}sum", "sum", n), Metric(f"{n}avg", "avg", n)]
    return out


# The feature families of the live feature view.
MATCH_METRICS: tuple[Metric, ...] = (
    Metric("tot_time_in_cage", "sum", "fight_time_minutes", sep="_"),
    Metric("weight_avg", "avg", "weight_of_fight", frames=("3",), post_default=1.0),
    Metric("sigstr_pm", "rate", "sigstracc", "fight_time_minutes"),
    Metric("tdavg", "rate", "tdacc", "fight_time_minutes", scale=15),
    Metric("sapm", "rate", "sigstrabs", "fight_time_minutes"),
    Metric("subavg", "rate", "subatt", "fight_time_minutes", scale=15),
    Metric("tddef", "one_minus_ratio", "tdabs", "tdattfromopp"),
    Metric("sigstr_perc", "rate", "sigstracc", "sigstratt"),
    Metric("sigstraccsum", "sum", "sigstracc", frames=("",)),
    Metric("ostrabssum", "sum", "sigstracc", frames=("",), sides=("postcomp_",)),
    Metric("strdef", "one_minus_ratio", "sigstrabs", "sigstrattfromopp"),
    Metric("tdacc_perc", "rate", "tdacc", "tdatt"),
    Metric("totalacc_perc", "rate", "totalacc", "totalatt"),
    Metric("headacc_perc", "rate", "headacc", "headatt"),
    Metric("bodyacc_perc", "rate", "bodyacc", "bodyatt"),
    Metric("legacc_perc", "rate", "legacc", "legatt"),
    Metric("distacc_perc", "rate", "distacc", "distatt"),
    Metric("clinchacc_perc", "rate", "clinchacc", "clinchatt"),
    Metric("groundacc_perc", "rate", "groundacc", "groundatt"),
    Metric("boutcount", "count", frames=("",)),
    *sum_and_avg(
        "win", "loss", "kd", "kdd", "ko", "kod", "subw", "subwd",
        "udec", "udecd", "sdec", "sdecd", "mdec", "mdecd",
    ),
)


def history_features(
    df: DataFrame,
    entity: str | Sequence[str],
    order: Sequence[str],
    metrics: Sequence[Metric] = MATCH_METRICS,
    *,
    limit: int | None = None,
    hot: tuple[DataFrame | None, int] | None = None,
) -> DataFrame:
    """Add every feature column of ``metrics`` for every frame.

    One shuffle by entity serves all frames, and each windowed sum is computed
    once and shared by all the ratios that need it. Sums of whole-number columns
    are differences of one running sum at a few distances back, so the cost does
    not grow with the number of frames; other columns are summed frame by frame,
    which keeps floating-point results free of cancellation. ``order`` must be
    unique within the entity (time, then match id). ``df`` is counted by entity
    and then scanned: write it first where it is costly to build. ``hot`` as in ``ordered_scan``.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    bases = list(dict.fromkeys(c for m in metrics for c in (m.num, m.den) if c))
    averaged = dict.fromkeys(m.num for m in metrics if m.kind == "avg")
    present = {f"_has_{c}": F.col(c).isNotNull().cast("bigint") for c in averaged}
    whole = [c for c in bases if isinstance(df.schema[c].dataType, T.IntegralType)]
    running = ["_one", *present, *whole]
    needed = _needed_sums(metrics)

    def build(d: DataFrame, w) -> DataFrame:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)

        def run(c: str):
            return F.count(c.removeprefix("_has_")) if c in present and c not in d.columns else F.sum(c)

        cum = d.select(
            "*",
            F.struct(*[F.coalesce(run(c).over(upto), F.lit(0)).alias(c) for c in running]).alias("_at0"),
            *[
                F.sum(c).over(f.over(w)).alias(f"_s{i}_{c}")
                for i, f in enumerate(FRAMES) for c in needed[i] if c not in running
            ],
        )
        back = sorted({k for f in FRAMES for k in _distances(f) if k})
        none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in running])
        far = cum.select("*", *[F.call_function("lag", F.col("_at0"), F.lit(k), none).over(w).alias(f"_at{k}") for k in back])
        totals = {}  # each windowed sum is a column of its own, computed once for all features

        def windowed(i: int, c: str) -> str:
            name = f"`_w{i}_{c}`"
            ends = [f"_at{k}.`{c}`" for k in _distances(FRAMES[i])] if c in running else [f"coalesce(`_s{i}_{c}`, 0)"]
            totals[name] = f"{' - '.join(ends)} AS {name}"
            return name

        features = [_feature(m, f, lambda c, i=i: windowed(i, c)) for m in metrics for i, f in enumerate(FRAMES) if m.wanted(f)]
        own = [f"`{c}`" for c in d.columns]
        return far.selectExpr(*own, *totals.values()).selectExpr(*own, *features)

    return ordered_scan(df, keys, order, build, reach=5, sums=[*bases, *present], limit=limit, hot=hot, seeded=present)


def _distances(f: Frame) -> list[int]:
    """Rows back at which running sums bound the frame: its end, then just before its start."""
    return [-f.end] if f.start is None else [-f.end, 1 - f.start]


def _needed_sums(metrics: Sequence[Metric]) -> list[list[str]]:
    """Columns summed per frame."""
    return [list(dict.fromkeys(c for m in metrics if m.wanted(f) for c in (m.num, m.den) if c)) for f in FRAMES]


def _feature(m: Metric, f: Frame, total) -> str:
    """SQL text of one feature; ``total(column)`` is the text of its windowed sum."""
    def over(num: str, den: str, scale: str, none: str) -> str:
        return f"CASE WHEN {den} = 0 THEN {none}D ELSE try_divide(CAST({num} AS DOUBLE){scale}, CAST({den} AS DOUBLE)) END"

    if m.kind == "sum":
        value = total(m.num)
    elif m.kind == "count":
        value = total("_one")
    elif m.kind == "avg":
        default = m.post_default if f.prefix == "postcomp_" else 0.0
        value = over(total(m.num), total(f"_has_{m.num}"), "", str(float(default)))
    elif m.kind == "rate":
        value = over(total(m.num), total(m.den), f" * {float(m.scale)}D" if m.scale != 1 else "", "0.0")
    elif m.kind == "one_minus_ratio":
        value = f"CASE WHEN {total(m.den)} = 0 THEN 0.0D ELSE 1 - ({over(total(m.num), total(m.den), '', '0.0')}) END"
    else:
        raise ValueError(f"unknown metric kind {m.kind}")
    return f"{value} AS `{m.column(f)}`"


def feature_names(metrics: Sequence[Metric] = MATCH_METRICS, prefix: str | None = None) -> list[str]:
    return [m.column(f) for m in metrics for f in FRAMES if m.wanted(f) and prefix in (None, f.prefix)]


def model_features(columns: Sequence[str]) -> list[str]:
    """Columns a model may see: anything computed after the match is refused."""
    leaks = [c for c in columns if c.removeprefix("opp_").startswith("postcomp_")]
    if leaks:
        raise ValueError(f"features known only after the match: {leaks}")
    return list(columns)
