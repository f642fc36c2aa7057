"""Per-entity sequence columns: lags, rolling sums, gaps, streaks, carried values, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.plans.ordered import ordered_scan
from duelframe.plans.sizing import oversized_groups


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_difference(df, keys, order, value: str, out: str, **kw) -> DataFrame:
    """value - previous value of the entity, 0 on its first row."""
    def build(d, w):
        return d.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))

    return ordered_scan(df, _names(keys), order, build, reach=1, **kw)


def rolling_sums(df, keys, order, value: str, sizes: Sequence[int] = (3, 5), pattern="{value}_change_{n}", **kw):
    """Sum over the last n rows including this one; short histories use what is there."""
    def build(d, w):
        return d.select("*", *[
            F.sum(value).over(w.rowsBetween(-(n - 1), 0)).alias(pattern.format(value=value, n=n)) for n in sizes
        ])

    return ordered_scan(df, _names(keys), order, build, reach=max(sizes), **kw)


def previous_row(df, keys, order, columns: Sequence[str], out: str = "prev", **kw) -> DataFrame:
    """Struct of the entity's previous row."""
    def build(d, w):
        return d.withColumn(out, F.lag(F.struct(*columns)).over(w))

    return ordered_scan(df, _names(keys), order, build, reach=1, **kw)


def days_since_previous(df, keys, order, ts: str, out: str = "gap_days", **kw) -> DataFrame:
    def build(d, w):
        return d.withColumn(out, F.datediff(F.col(ts), F.lag(ts).over(w)))

    return ordered_scan(df, _names(keys), order, build, reach=1, **kw)


def matches_before(df, keys, order, out: str = "matches_before", **kw) -> DataFrame:
    def build(d, w):
        return d.withColumn(out, F.sum("_one").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)

    return ordered_scan(df, _names(keys), order, build, reach=1, **kw)


def numbered(df, keys, order, out: str = "seq", **kw) -> DataFrame:
    """1, 2, 3, ... within the group, for groups of any size."""
    def build(d, w):
        return d.withColumn(out, F.sum("_one").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    return ordered_scan(df, _names(keys), order, build, reach=1, **kw)


def win_streak_before(df, keys, order, won: Column, out: str = "streak_before", **kw) -> DataFrame:
    """Consecutive wins immediately before each row: rows so far minus the row number of the last non-win."""
    kw.setdefault("hot", oversized_groups(df, _names(keys), kw.get("limit")))
    base = numbered(df, keys, order, "_n", **kw).withColumn("_lost_at", F.when(~won, F.col("_n")))

    def build(d, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn(out, F.col("_n") - 1 - F.coalesce(F.max("_lost_at").over(before), F.lit(0)))

    return ordered_scan(base, _names(keys), order, build, reach=1, maxes=["_lost_at"], **kw).drop("_n", "_lost_at")


def carry_forward(df, keys, order, mapping: dict[str, str], since: Column, **kw) -> DataFrame:
    """From ``since`` on, replace each pre column by the previous row's post column (first rows keep theirs)."""
    posts = list(dict.fromkeys(mapping.values()))

    def build(d, w):
        prev = d.withColumn("_prev", F.lag(F.struct(*posts)).over(w))
        swap = {
            pre: F.when(since & F.col("_prev").isNotNull(), F.col(f"_prev.{post}")).otherwise(F.col(pre))
            for pre, post in mapping.items()
        }
        return prev.withColumns(swap).drop("_prev")

    return ordered_scan(df, _names(keys), order, build, reach=1, **kw)


def last_n(df, keys, order, n: int, **kw) -> DataFrame:
    """The n most recent rows of every entity, newest = 1 in column ``recency``."""
    keys = _names(keys)
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(window)).where(F.col("recency") <= n)


def latest_row(df, keys, order) -> DataFrame:
    """Most recent row of every entity, by partial aggregation rather than a sort."""
    keys = _names(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def running_totals(df, order, columns: Sequence[str], prefix: str = "cum_", keys: Sequence[str] = (), **kw) -> DataFrame:
    """Running sums over the whole table in time order."""
    def build(d, w):
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return d.select("*", *[F.sum(c).over(upto).alias(f"{prefix}{c}") for c in columns])

    return ordered_scan(df, list(keys), order, build, reach=1, sums=columns, **kw)


def history_pages(df, keys, order, columns: Sequence[str], page_rows: int = 1000, **kw) -> DataFrame:
    """Ordered arrays of every entity's rows, split into pages so no array grows without bound."""
    keys = _names(keys)
    rows = numbered(df, keys, order, "_n", **kw).withColumn("page", F.floor((F.col("_n") - 1) / page_rows).cast("int"))
    item = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *columns])])
    return rows.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(item)).alias("versions"))


def either_role(df: DataFrame, entity: str, opponent: str, who: Column, prefix: str = "opp_") -> DataFrame:
    """Rows in which ``who`` takes part, turned so that it is always the first side."""
    twins = {c: prefix + c for c in df.columns if prefix + c in df.columns}
    twins[entity] = opponent
    back = {v: k for k, v in twins.items()}
    flip = F.col(opponent) == who

    def pick(c):
        other = twins.get(c) or back.get(c)
        return F.col(c) if other is None else F.when(flip, F.col(other)).otherwise(F.col(c)).alias(c)

    return df.where((F.col(entity) == who) | flip).select(*[pick(c).alias(c) for c in df.columns])
