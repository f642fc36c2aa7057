"""Intermediate tables in the shared folder, and the row identity all operators use."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.session import ensure_checkpoint_dir

TEXT_KEY = "_text_key"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a scratch folder only in a single process (tests), never on a cluster."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def stage(df: DataFrame, what: str, give_back: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Lineage ends here, so a lost executor costs a re-read and not a recomputation. The shuffle files of the
    finished job are given back at once, unless they are too small for that to matter.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    schema = df.schema
    del df
    if give_back:
        gc.collect()
        spark._jvm.System.gc()
    table = spark.read.schema(schema).parquet(folder)
    table._stage_folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stage_folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and a content key of rows that have an id; a null text counts as empty.

    (doc_id, content key) identifies a row: rows that repeat both are copies and get the same result, and rows
    that share an id but not a text stay apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias(TEXT_KEY)
    )


def row_key(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def same_at_every_size(table: DataFrame) -> DataFrame:
    """Join with ``table`` by sorting both sides, also where it happens to be small: it grows with the input, and texts
    that travel for one size should travel for all."""
    return table.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
