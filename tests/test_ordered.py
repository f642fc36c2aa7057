"""Oversized groups give the same answer as the plain window."""

import random

from pyspark.sql import Window, functions as F

from duelframe.plans.ordered import ordered_scan


def build(df, w):
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "*",
        F.sum("v").over(before).alias("sum_before"),
        F.sum("v").over(upto).alias("sum_upto"),
        F.sum("_one").over(upto).alias("n"),
        F.max("m").over(before).alias("max_before"),
        F.last("snap", ignorenulls=True).over(before).alias("last_snap"),
        F.sum("v").over(w.rowsBetween(-5, -1)).alias("last5"),
        F.sum("v").over(w.rowsBetween(-2, 0)).alias("last3"),
        F.lag("v").over(w).alias("prev"),
    )


def test_hot_key_equals_plain_window(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else (None if i % 2 else f"k{i % 40}")
        rows.append((key, rng.randint(0, 30), i, rng.randint(-9, 9), i if rng.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "k string, ts int, id int, v int, snap int").withColumn("m", F.col("v"))
    args = dict(reach=5, sums=["v"], maxes=["m"], lasts=["snap"])
    plain = ordered_scan(df, ["k"], ["ts", "id"], build, limit=10_000, **args)
    split = ordered_scan(df, ["k"], ["ts", "id"], build, limit=25, **args)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_no_key_means_one_global_sequence(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("ts"), F.col("id"), F.lit(1).alias("v"))

    def running(d, w):
        return d.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    out = ordered_scan(df, [], ["ts", "id"], running, sums=["v"], limit=9)
    assert {(r.ts, r.s) for r in out.collect()} == {(t, t + 1) for t in range(100)}
    assert out.columns == ["ts", "id", "v", "s"]


def test_inherited_totals_may_exceed_the_column_type(spark):
    big = 2_000_000_000
    df = spark.range(40).select(F.lit("k").alias("k"), F.col("id"), F.lit(big).cast("int").alias("v"))

    def running(d, w):
        return d.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    out = ordered_scan(df, ["k"], ["id"], running, sums=["v"], reach=2, limit=10)
    assert out.schema["v"].dataType.simpleString() == "int"
    assert {(r.id, r.s) for r in out.collect()} == {(i, (i + 1) * big) for i in range(40)}
