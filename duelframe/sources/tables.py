"""Reading and writing tables: declared schemas, stage tables, CSV in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duelframe.functions.numbers import round_doubles
from duelframe.functions.text import any_date


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column layouts of the raw tables; everything arrives as text.
EVENTS = text_schema("EVENT", "URL", "DATE", "LOCATION")
MATCHES = text_schema("EVENT", "BOUT", "URL")
RESULTS = text_schema("EVENT", "BOUT", "OUTCOME", "WEIGHTCLASS", "METHOD", "ROUND", "TIME", "TIME FORMAT", "REFEREE", "DETAILS", "URL")
ROUND_STATS = text_schema("EVENT", "BOUT", "ROUND", "FIGHTER", "KD", "SIG.STR.", "SIG.STR. %", "TOTAL STR.", "TD", "TD %", "SUB.ATT",
                          "REV.", "CTRL", "HEAD", "BODY", "LEG", "DISTANCE", "CLINCH", "GROUND")
PEOPLE = text_schema("FIRST", "LAST", "NICKNAME", "URL")
ATTRIBUTES = text_schema("FIGHTER", "HEIGHT", "WEIGHT", "REACH", "STANCE", "DOB", "URL")
RAW_TABLES = {
    "events": EVENTS, "matches": MATCHES, "results": RESULTS, "round_stats": ROUND_STATS, "people": PEOPLE, "attributes": ATTRIBUTES,
}

# Weight classes, their index, limit in pounds and sex.
CATEGORY_ROWS = [
    ("Strawweight", 1, 115, 1), ("Women's Flyweight", 2, 125, 1), ("Women's Bantamweight", 3, 135, 1), ("Women's Featherweight", 4, 145, 1),
    ("Flyweight", 5, 125, 2), ("Bantamweight", 6, 135, 2), ("Featherweight", 7, 145, 2), ("Lightweight", 8, 155, 2),
    ("Welterweight", 9, 170, 2), ("Middleweight", 10, 185, 2), ("Light Heavyweight", 11, 205, 2), ("Heavyweight", 12, 265, 2),
]


def category_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_ROWS, "weightclass string, weightindex int, weight int, sex int")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with declared columns; the header line is skipped, nothing is inferred."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').csv(paths)


def read_csv_dated(spark: SparkSession, path: str, schema: T.StructType, dates: Mapping[str, Sequence[str]]) -> DataFrame:
    """CSV whose date columns are parsed with the first matching format."""
    df = read_csv(spark, path, schema)
    return df.withColumns({c: any_date(c, list(formats)) for c, formats in dates.items()})


def read_table(spark: SparkSession, name_or_sql: str) -> DataFrame:
    """A catalogued table, or the result of a SQL string."""
    return spark.sql(name_or_sql) if " " in name_or_sql.strip() else spark.table(name_or_sql)


def read_jdbc(spark: SparkSession, url: str, table: str, partition: Mapping | None = None, **options) -> DataFrame:
    """External database table; ``partition`` holds column, lower, upper and n for a parallel scan."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        reader = reader.options(partitionColumn=partition["column"], lowerBound=partition["lower"],
                                upperBound=partition["upper"], numPartitions=partition["n"])
    return reader.load()


def read_matchups(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Two-column list of announced pairings, trimmed, incomplete lines dropped."""
    df = read_csv(spark, path, text_schema("a", "b"), header)
    return df.select(F.trim("a").alias("a"), F.trim("b").alias("b")).where((F.col("a") != "") & (F.col("b") != ""))


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """Write a managed table, replacing an older one; buckets co-locate later joins on the same key."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as parquet and go on from the file."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header line; ``digits`` rounds floating columns."""
    (df if digits is None else round_doubles(df, digits)).write.mode("overwrite").option("header", True).csv(path)


def reset(spark: SparkSession, derived: Sequence[str], base: Mapping[str, Sequence[str]]) -> None:
    """Drop derived tables and views and cut base tables back to their base columns."""
    for name in derived:
        spark.sql(f"DROP VIEW IF EXISTS {name}") if _is_view(spark, name) else spark.sql(f"DROP TABLE IF EXISTS {name}")
    for name, columns in base.items():
        kept = spark.table(name).select(*[f"`{c}`" for c in columns])
        replace_table(kept, f"{name}_base")
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"ALTER TABLE {name}_base RENAME TO {name}")


def _is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType in ("VIEW", "TEMPORARY")


def column_like(df: DataFrame, word: str) -> str | None:
    """First column whose name contains the word."""
    return next((c for c in df.columns if word in c.lower()), None)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first
