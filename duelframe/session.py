"""Session construction and the session-level knobs the library reads."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Largest number of rows one task may be handed as a single sorted group.
MAX_GROUP_ROWS = "spark.duelframe.maxGroupRows"
MAX_GROUP_ROWS_DEFAULT = 2_000_000

# Largest number of rows the library will ask Spark to broadcast.
MAX_BROADCAST_ROWS = "spark.duelframe.maxBroadcastRows"
MAX_BROADCAST_ROWS_DEFAULT = 200_000


def local_session(app: str = "duelframe", cores: str = "*", shuffle_partitions: int = 8, parallelism: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    if parallelism:
        builder = builder.config("spark.default.parallelism", str(parallelism))
    return (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def int_setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def max_group_rows(spark: SparkSession) -> int:
    return int_setting(spark, MAX_GROUP_ROWS, MAX_GROUP_ROWS_DEFAULT)


def max_broadcast_rows(spark: SparkSession) -> int:
    return int_setting(spark, MAX_BROADCAST_ROWS, MAX_BROADCAST_ROWS_DEFAULT)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; a scratch folder only in one process, where it is shared by nature."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="duelframe-checkpoint-"))
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package when it is not installed on them; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="duelframe-package-"), "duelframe")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(app)
