"""Ordered windows whose groups may be larger than one task.

A Spark window hands every row of a partition key to one task. That is the right
plan while groups are short, and the wrong one when a single entity owns a third
of the table. ``ordered_scan`` keeps the plain window for ordinary keys and cuts
oversized keys into consecutive chunks:

1. range-partition the oversized rows by (key, order) and checkpoint them, so a
   chunk is a physical partition that stays the same when a task is re-run;
2. summarise each (key, chunk): sums, maxima, last values and its last few rows;
3. run a short window over the summaries (one row per chunk) to learn what every
   chunk inherits from the chunks before it;
4. put the inherited rows in front of the chunk and run the same window code
   with (key, chunk) as partition key.

``build(df, w)`` adds the window columns. It may use frames starting at
``unboundedPreceding`` with ``sum`` over columns named in ``sums``, ``max`` over
columns in ``maxes``, ``last(..., ignorenulls=True)`` over columns in ``lasts``,
and any frame or ``lag`` reaching at most ``reach`` rows back. Row counts are
``sum("_one")``. Frames never look ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from duelframe.plans.sizing import cut, oversized_groups, same_key, small_side
from duelframe.session import max_group_rows

Build = Callable[[DataFrame, WindowSpec], DataFrame]

_CONST = "_whole_table"


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Build,
    *,
    reach: int = 5,
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    lasts: Sequence[str] = (),
    limit: int | None = None,
    hot: tuple[DataFrame | None, int] | None = None,
    seeded: Mapping[str, Column] = MappingProxyType({}),
) -> DataFrame:
    """Run ``build`` over every group of ``keys`` in ``order``.

    ``hot`` is the answer of ``oversized_groups(df, keys)``; pass it when several
    scans run over the same keys, so that the groups are counted once. ``seeded``
    holds columns that only chunks get, to carry on what ``build`` derives itself
    where a group is whole.
    """
    keys, order = list(keys), list(order)
    carried = [*sums, *maxes, *lasts]
    if len(carried) != len(set(carried)):
        raise ValueError("a column can be carried in one way only; alias a copy of it")
    df = df.withColumn("_one", F.lit(1).cast("bigint"))
    if not keys:
        keys, df = [_CONST], df.withColumn(_CONST, F.lit(0))
    limit = limit or max_group_rows(df.sparkSession)
    hot, hot_rows = hot or oversized_groups(df, keys, limit)
    window = Window.partitionBy(*keys).orderBy(*order)
    helpers = ["_one"] + ([_CONST] if keys == [_CONST] else [])
    if hot is None:
        return build(df, window).drop(*helpers)
    hot = small_side(hot)  # at most rows / limit keys; sent to the tasks only if that is proven small
    on = same_key(df, hot, keys)
    short, long = df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")
    sums = list(dict.fromkeys([*sums, "_one"]))
    plain = build(short, window)
    long = long.withColumns(dict(seeded)) if seeded else long
    chunked = _chunked(_widened(long, sums), keys, order, build, reach, sums, list(maxes), list(lasts), hot_rows, limit)
    same_types = chunked.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in plain.schema.fields])
    return plain.unionByName(same_types).drop(*helpers)


def _widened(df: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Summed columns in the type of their sum, so that an inherited total always fits."""
    wide = df.agg(*[F.sum(c).alias(c) for c in sums]).schema
    return df.withColumns({c: F.col(c).cast(wide[c].dataType) for c in sums if wide[c].dataType != df.schema[c].dataType})


def _chunked(long, keys, order, build, reach, sums, maxes, lasts, hot_rows, limit) -> DataFrame:
    parts = max(2, -(-2 * hot_rows // limit))
    columns = long.columns
    rows = cut(long.repartitionByRange(parts, *keys, *order)).withColumn("__chunk", F.spark_partition_id())
    seq = F.struct(*order)

    # What each chunk leaves behind.
    tail_window = Window.partitionBy(*keys, "__chunk").orderBy(*[F.col(c).desc() for c in order])
    tails = (
        rows.withColumn("__back", F.row_number().over(tail_window))
        .where(F.col("__back") <= reach)
        .groupBy(*keys, "__chunk")
        .agg(F.array_sort(F.collect_list(F.struct(seq.alias("_seq"), F.struct(*columns).alias("_row")))).alias("_tail"))
    )
    totals = rows.groupBy(*keys, "__chunk").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        *[F.max(c).alias(f"_max_{c}") for c in maxes],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(f"_last_{c}") for c in lasts],
    )
    chunk_keys = [*keys, "__chunk"]
    totals_on = same_key(totals, tails, chunk_keys)
    summary = totals.join(tails, totals_on).select(
        *[totals[c] for c in totals.columns], tails["_tail"]
    )

    # What each chunk inherits: one summary row per chunk, so this window is short.
    over = Window.partitionBy(*keys).orderBy("__chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    inherited = summary.select(
        *chunk_keys,
        F.flatten(F.collect_list("_tail").over(over.rowsBetween(-reach, -1))).alias("_full"),
        *[F.sum(f"_sum_{c}").over(before).alias(f"_sum_{c}") for c in sums],
        *[F.max(f"_max_{c}").over(before).alias(f"_max_{c}") for c in maxes],
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in lasts],
    ).withColumn(
        "_ghosts",
        F.when(F.size("_full") > reach, F.slice("_full", -reach, reach)).otherwise(F.col("_full")),
    )

    schema = {f.name: f.dataType for f in rows.schema.fields}
    ghosts = inherited.select(*chunk_keys, F.explode("_ghosts").alias("_g")).select(
        *[F.col(f"_g._row.{c}").alias(c) for c in columns],
        "__chunk",
        F.lit(1).alias("__pos"),
        F.lit(True).alias("__ghost"),
    )

    def seed(c):
        if c in keys:
            return F.col(c)
        if c in sums:
            held = F.aggregate(
                F.transform("_ghosts", lambda g: g["_row"][c]),
                F.lit(0).cast(schema[c]),
                lambda acc, x: (acc + F.coalesce(x, F.lit(0).cast(schema[c]))).cast(schema[c]),
            )
            return (F.col(f"_sum_{c}") - held).cast(schema[c]).alias(c)
        if c in maxes:
            return F.col(f"_max_{c}").alias(c)
        if c in lasts:
            return F.col(f"_last_{c}").alias(c)
        return F.lit(None).cast(schema[c]).alias(c)

    seeds = inherited.where(F.col("_sum__one") > reach).select(
        *[seed(c) for c in columns], "__chunk", F.lit(0).alias("__pos"), F.lit(True).alias("__ghost")
    )
    body = rows.select(*columns, "__chunk", F.lit(1).alias("__pos"), F.lit(False).alias("__ghost"))
    window = Window.partitionBy(*chunk_keys).orderBy("__pos", *order)
    built = build(body.unionByName(ghosts).unionByName(seeds), window)
    return built.where(~F.col("__ghost")).drop("__chunk", "__pos", "__ghost")
