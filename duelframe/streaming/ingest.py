"""Incremental ingest: rows above a high-water mark, each key once; snapshots merged with the last one winning.

What a batch costs follows the batch: known keys live in the state store of the streaming query, which is asked for the
batch's keys only, and merged snapshots in buckets, of which a batch rewrites those it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from duelframe.operators.clean import last_per_key
from duelframe.streaming.buckets import BucketTable

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def new_rows(stream: DataFrame, ts: str, after=None) -> DataFrame:
    """Rows newer than the column or literal ``after``, however late they arrive."""
    return stream if after is None else stream.where(F.col(ts) > after)


def start_with_state(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a query whose state lies on the executors' disks and is saved as changes; the session's settings stay as they were."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_arrivals(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, with the smallest of the rows that its first micro-batch brought; for output mode ``update``.

    The state of a key is its first row and the last instant it was seen. All rows of a micro-batch carry one instant, so a
    key is new exactly when both are equal. State does not expire: a copy may come any number of batches later.
    """
    keys = list(keys)
    rest = [c for c in stream.columns if c not in keys]
    seen = stream.withColumn("_at", F.current_timestamp()).groupBy(*keys).agg(F.min(F.struct("_at", *rest)).alias("_first"), F.max("_at").alias("_last"))
    return seen.where(F.col("_first._at") == F.col("_last")).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in stream.columns])


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Append rows whose key has never arrived before; several rows of one key in a batch leave the smallest of them.

    The stored table is only written, never read: a batch costs what its own keys cost. A batch is a folder of its
    own, so repeating it gives the same result.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = first_arrivals(stream, keys).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return start_with_state(stream.sparkSession, writer)


def high_water_mark(df: DataFrame, ts: str):
    """Newest instant already stored, None for an empty table."""
    return df.agg(F.max(ts).alias("t")).first().t


def merge_snapshots(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], snapshot: Sequence[str], buckets: int = 64) -> StreamingQuery:
    """Keep the latest snapshot of every key across all batches, in a ``BucketTable`` under ``path``."""
    keys, order = list(keys), list(snapshot)
    schema = stream.schema

    def run(batch: DataFrame, epoch: int) -> None:
        table = BucketTable(batch.sparkSession, path, keys, buckets)
        newest = last_per_key(batch, keys, order).persist()
        touched = table.touched(newest)
        both = table.read(epoch - 1, schema, touched).unionByName(newest)
        table.replace(epoch, last_per_key(both, keys, order), touched)
        newest.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The merged table after the last batch, found in its manifest; no older folder is read."""
    table = BucketTable(spark, path, [])
    return table.read(table.newest())
