"""Aggregations: roll-ups, records, summaries, correlations, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.functions.text import attempted, clock_seconds, landed, lenient_int
from duelframe.plans.ordered import ordered_scan
from duelframe.plans.sizing import cut


def roll_up(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], count: str | None = None) -> DataFrame:
    """Sum named expressions per key, combined map-side."""
    aggs = [F.sum(e).alias(n) for n, e in sums.items()]
    if count:
        aggs.append(F.count(F.lit(1)).alias(count))
    return df.groupBy(*keys).agg(*aggs)


def roll_up_cells(df: DataFrame, keys: Sequence[str], *, pairs: Mapping[str, str] = {}, counts: Mapping[str, str] = {},
                  clocks: Mapping[str, str] = {}) -> DataFrame:
    """Round text cells to match totals: "n of m" gives <name>acc and <name>att, counts and clocks give one sum each."""
    sums: dict[str, Column] = {}
    for name, cell in pairs.items():
        sums[f"{name}acc"] = landed(F.col(f"`{cell}`"))
        sums[f"{name}att"] = attempted(F.col(f"`{cell}`"))
    for name, cell in counts.items():
        sums[name] = lenient_int(F.col(f"`{cell}`"))
    for name, cell in clocks.items():
        sums[name] = clock_seconds(F.col(f"`{cell}`"))
    return roll_up(df, keys, sums)


# Cell columns of the per-round table and the names of their totals.
ROUND_PAIRS = {
    "sigstr": "SIG.STR.", "td": "TD", "total": "TOTAL STR.", "head": "HEAD", "body": "BODY", "leg": "LEG",
    "dist": "DISTANCE", "clinch": "CLINCH", "ground": "GROUND",
}
ROUND_COUNTS = {"kd": "KD", "rev": "REV.", "subatt": "SUB.ATT"}
ROUND_CLOCKS = {"ctrl": "CTRL"}


def match_stats(rounds: DataFrame, keys: Sequence[str] = ("EVENT", "BOUT", "FIGHTER")) -> DataFrame:
    """The 21 match totals of the per-round table."""
    return roll_up_cells(rounds, keys, pairs=ROUND_PAIRS, counts=ROUND_COUNTS, clocks=ROUND_CLOCKS)


def career_record(df: DataFrame, keys: Sequence[str], won: Column, latest: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Matches, wins, losses, win rate and the latest attributes per entity."""
    wins = F.count_if(won)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), wins.alias("wins"), F.max_by(F.struct(*latest), F.struct(*order)).alias("_l"),
    )
    return out.select(
        *keys, "matches", "wins", (F.col("matches") - F.col("wins")).alias("losses"),
        (F.col("wins") / F.col("matches")).alias("win_rate"), *[F.col(f"_l.{c}").alias(f"latest_{c}") for c in latest],
    )


def accuracy_by(df: DataFrame, keys: Sequence[str], correct: Column, gap: Column | None = None) -> DataFrame:
    """Hit counts and rates per group, with mean and sample deviation of the rating gap."""
    aggs = [
        F.count(F.lit(1)).alias("total"), F.sum(correct.cast("bigint")).alias("correct"), F.avg(correct.cast("double")).alias("accuracy"),
    ]
    if gap is not None:
        aggs += [F.avg(gap).alias("avg_gap"), F.stddev_samp(gap).alias("std_gap")]
    return df.groupBy(*keys).agg(*aggs)


def best_and_worst(df: DataFrame, score: str, size: str, min_size: int, n: int, tie: Sequence[str]) -> DataFrame:
    """The n best and n worst groups of at least ``min_size`` rows; both ends read one materialised table."""
    big = cut(df.where(F.col(size) >= min_size))
    top = big.orderBy(F.col(score).desc(), *tie).limit(n).withColumn("end", F.lit("top"))
    low = big.orderBy(F.col(score).asc(), *tie).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)


def peak_per_entity(df: DataFrame, entity: str, value: str) -> DataFrame:
    return df.groupBy(entity).agg(F.max(value).alias(f"peak_{value}"))


def best_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum per group and the group with the largest sum, as one row."""
    sums = df.groupBy(key).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
    return sums.agg(
        F.max_by(key, F.struct(F.col(value), F.col(key))).alias(key),
        F.max(value).alias(value), F.max_by("n", F.struct(F.col(value), F.col(key))).alias("n"),
    )


def category_counts(df: DataFrame, category: str, names: DataFrame, name: str) -> DataFrame:
    """Rows per category with its display name; the category itself when it has none."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names.select(category, name), category, "left").withColumn(
        name, F.coalesce(F.col(name), F.col(category).cast("string"))
    )


def pivot_mean(df: DataFrame, keys: Sequence[str], column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Mean per key and column value, one output column per listed value."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(value))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column; quartiles are exact."""
    from duelframe.plans.quantiles import exact_quantiles_of

    quartiles = exact_quantiles_of(df, {c: [0.25, 0.5, 0.75] for c in columns})
    stats = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), *[F.lit(q).cast("double").alias(n) for q, n in zip(quartiles[c], ("q25", "median", "q75"))],
            F.max(c).cast("double").alias("max"),
        ) for c in columns
    ]).alias("_rows"))
    return stats.select(F.explode("_rows").alias("_r")).select("_r.*")


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of every column with the target in one pass, strongest first."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "corr").orderBy(F.abs("corr").desc_nulls_last(), "feature")


def with_group_size(df: DataFrame, key: str, out: str) -> DataFrame:
    from duelframe.operators.clean import with_appearances

    return with_appearances(df, key, out)


def interval_stats(df: DataFrame, entity: str, order: Sequence[str], ts: str, flag: Column | None = None, **kw) -> DataFrame:
    """Mean and longest gap between consecutive rows per entity, and the mean split by ``flag``."""
    from duelframe.operators.sequence import days_since_previous

    gaps = days_since_previous(df if flag is None else df.withColumn("_flag", flag), entity, order, ts, "_gap", **kw)
    aggs = [F.avg("_gap").alias("avg_days"), F.max("_gap").alias("max_days")]
    if flag is not None:
        aggs += [F.avg(F.when(F.col("_flag"), F.col("_gap"))).alias("avg_days_flagged"),
                 F.avg(F.when(~F.col("_flag"), F.col("_gap"))).alias("avg_days_other")]
    return gaps.groupBy(entity).agg(*aggs)


def rating_summary(df: DataFrame, pre: str, post: str) -> DataFrame:
    change = F.col(post) - F.col(pre)
    return df.agg(
        F.avg(change).alias("mean_change"), F.avg(F.abs(change)).alias("mean_abs_change"), F.min(post).alias("min_rating"),
        F.max(post).alias("max_rating"), F.count(F.lit(1)).alias("n"),
    )


def normal_equation_sums(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """All sums of X'X and X'y (with intercept) in one aggregation."""
    cols = ["_bias", *features]
    base = df.dropna(subset=[*features, target]).withColumn("_bias", F.lit(1.0))
    return base.agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i],
        *[F.sum(F.col(a) * F.col(target)).alias(f"xy_{i}") for i, a in enumerate(cols)],
        F.sum(F.col(target) * F.col(target)).alias("yy"),
    )


def snapshot_coverage(probes: DataFrame, known: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Share of matches for which a snapshot of either and of both sides exists."""
    ids = known.select(F.col(key)).distinct().withColumn("_hit", F.lit(1))
    out = probes
    for side in (a, b):
        hit = ids.select(F.col(key).alias(side), F.col("_hit").alias(f"_hit_{side}"))
        out = out.join(hit, side, "left")
    ha, hb = (F.coalesce(F.col(f"_hit_{s}"), F.lit(0)) for s in (a, b))
    return out.agg(F.count(F.lit(1)).alias("matches"), F.avg(ha * hb).alias("both"), F.avg(F.greatest(ha, hb)).alias("any"))


def dataset_totals(df: DataFrame, entity: str, category: str, match: str, is_test: Column) -> DataFrame:
    return df.agg(
        F.count_distinct(entity).alias("entities"), F.count_distinct(category).alias("categories"),
        F.count_distinct(match).alias("matches"), F.count_if(~is_test).alias("train_rows"), F.count_if(is_test).alias("test_rows"),
    )


def distinct_entities(df: DataFrame, entity: str) -> DataFrame:
    return df.select(entity).distinct()


def auc_by(df: DataFrame, keys: Sequence[str], score: str, label: str, **kw) -> DataFrame:
    """Area under the ROC curve per group with tied scores counted half.

    Rows collapse to one per distinct score first; the running count of
    negatives below each score then comes from one ordered scan.
    """
    keys = list(keys)
    per_score = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.sum(1 - F.col(label).cast("bigint")).alias("_neg")
    )

    def build(d, w):
        from pyspark.sql import Window

        return d.withColumn("_below", F.coalesce(F.sum("_neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    ranked = ordered_scan(per_score, keys, [score], build, reach=1, sums=["_neg"], **kw)
    area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).cast("double")
    pairs = (F.sum("_pos") * F.sum("_neg")).cast("double")
    return ranked.groupBy(*keys).agg(F.try_divide(area, pairs).alias("auc"))
