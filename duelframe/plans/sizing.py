"""Size checks: what may be broadcast, which keys are too big for one task, where lineage is cut."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from duelframe.session import ensure_checkpoint_dir, max_broadcast_rows, max_group_rows


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder so later stages survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, limit: int | None = None, most_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven to hold at most ``limit`` rows and ``most_bytes`` (the probe itself reads no more rows than that)."""
    limit = limit or max_broadcast_rows(df.sparkSession)
    fixed = [f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType))]
    width = F.lit(16 * len(df.columns) + 16)
    for c in df.columns:
        if c not in fixed:
            width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    got = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return got["n"] <= limit and got["bytes"] <= most_bytes


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it is proven small, otherwise leave the join strategy to the optimizer."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on every key column."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def oversized_groups(df: DataFrame, keys: list[str], limit: int | None = None) -> tuple[DataFrame | None, int]:
    """Keys owning more than ``limit`` rows, and how many rows they own together.

    The count is a partially aggregated shuffle of the key columns only; the keys stay a written table and only their
    number and total reach the driver.
    """
    spark = df.sparkSession
    limit = limit or max_group_rows(spark)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    found = cut(counts)
    total = found.agg(F.sum("_rows")).first()[0]
    return (found.select(*keys), total) if total else (None, 0)


class Folder:
    """Tables of one job, each written once or by folders, in the checkpoint folder that driver and executors share."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("append").partitionBy(*by).parquet(f"{self.base}/{name}")

    def read(self, name: str, schema) -> DataFrame:
        """The table, or an empty one where nothing has been written."""
        if not self._at(name)[1]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def values(self, name: str) -> list[int]:
        """The whole-number values of the column by which a table has been written, ascending."""
        files, path = self._at(name)[0], self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        names = [f.getPath().getName() for f in files.listStatus(path)] if self._at(name)[1] else []
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, files.exists(path)
