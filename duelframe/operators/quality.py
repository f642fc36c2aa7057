"""Data-quality checks: continuity of pre and post values, mirror symmetry, reports and repairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from duelframe.plans.ordered import ordered_scan


def _keys(entity):
    return [entity] if isinstance(entity, str) else list(entity)


def continuity_rows(df: DataFrame, entity, order: Sequence[str], metrics: Mapping[str, str], tolerance: float = 0.01,
                    nulls_agree: bool = False, min_matches: int = 2, **kw) -> DataFrame:
    """One row per entity, consecutive pair of matches and metric: does pre(n+1) equal post(n)?

    ``metrics`` maps pre columns to post columns. All metrics share one window.
    """
    keys, posts = _keys(entity), list(dict.fromkeys(metrics.values()))

    def build(d, w):
        return d.withColumn("_prev", F.lag(F.struct(*posts)).over(w))

    source = df.select(*dict.fromkeys([*keys, *order, *metrics, *posts]))
    rows = ordered_scan(source, keys, list(order), build, reach=1, **kw).where(F.col("_prev").isNotNull())
    if min_matches > 2:
        enough = df.groupBy(*keys).count().where(F.col("count") >= min_matches).select(*keys)
        rows = rows.join(enough, keys, "left_semi")
    pairs = F.array(*[
        F.struct(F.lit(pre).alias("metric"), F.col(pre).cast("double").alias("pre"), F.col(f"_prev.{post}").cast("double").alias("post"))
        for pre, post in metrics.items()
    ])
    long = rows.select(*keys, *order, F.explode(pairs).alias("_m")).select(*keys, *order, "_m.*")
    agree = F.abs(F.col("pre") - F.col("post")) <= tolerance
    if nulls_agree:
        agree = F.when(F.col("pre").isNull() & F.col("post").isNull(), F.lit(True)).otherwise(F.coalesce(agree, F.lit(False)))
    return long.withColumn("agree", agree)


def continuity_report(rows: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Compared pairs, mismatches and match rate per group, worst first."""
    return rows.where(F.col("agree").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("agree")).alias("mismatches"),
        F.avg(F.col("agree").cast("double")).alias("match_rate"),
    ).orderBy("match_rate", F.desc("mismatches"), *by)


def repair_continuity(df: DataFrame, entity, order: Sequence[str], pre: str, post: str, tolerance: float = 1.0, **kw) -> DataFrame:
    """Where pre differs from the previous post by more than the tolerance, take the previous post."""
    def build(d, w):
        prev = F.lag(post).over(w)
        return d.withColumn("_prev", prev)

    out = ordered_scan(df, _keys(entity), list(order), build, reach=1, **kw)
    return out.withColumn(pre, F.when(F.abs(F.col(pre) - F.col("_prev")) > tolerance, F.col("_prev")).otherwise(F.col(pre))).drop("_prev")


def corrected_latest(df: DataFrame, entity, order: Sequence[str], pre: str, post: str, **kw) -> DataFrame:
    """Latest snapshot of every entity after the repair."""
    from duelframe.operators.sequence import latest_row

    return latest_row(repair_continuity(df, entity, order, pre, post, **kw), entity, order)


def mirror_report(df: DataFrame, match: Sequence[str], entity: str, columns: Sequence[str], prefix: str = "opp_",
                  tolerance: float = 1e-9) -> DataFrame:
    """Per column: how often side A's view of the opponent differs from side B's own value."""
    opp_key = prefix + entity
    own = df.select(*match, F.col(entity).alias(opp_key), *[F.col(c).alias(f"_own_{c}") for c in columns])
    both = df.join(own, [*match, opp_key], "left")
    wide = both.agg(*[
        F.count_if(~F.coalesce(F.abs(F.col(prefix + c) - F.col(f"_own_{c}")) <= tolerance, F.lit(False))).alias(c) for c in columns
    ])
    return wide.unpivot([], list(columns), "column", "mismatches")
