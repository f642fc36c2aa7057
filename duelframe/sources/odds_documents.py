"""Nested odds documents to long and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Shape of an odds document.
ODDS_SCHEMA = (
    "id string, commence_time string, home_team string, away_team string, bookmakers array<struct<key: string, "
    "markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>"
)
EDGE_SCHEMA = (
    "edges array<struct<node: struct<id: string, fighter1: struct<firstName: string, lastName: string>, "
    "fighter2: struct<firstName: string, lastName: string>, odds: array<struct<book: string, odds1: int, odds2: int>>>>>"
)


def read_odds_json(spark: SparkSession, path: str) -> DataFrame:
    """A file holding one array of events (or one event per line)."""
    return spark.read.schema(ODDS_SCHEMA).option("multiLine", True).json(path)


def long_odds(documents: DataFrame, market: str = "h2h") -> DataFrame:
    """One row per event, book and outcome of the market; the unwanted markets are cut before exploding."""
    books = documents.select(
        "id", F.to_date(F.to_timestamp("commence_time")).alias("date"), "home_team", "away_team", F.explode("bookmakers").alias("_b")
    )
    markets = books.select("*", F.explode(F.filter("_b.markets", lambda m: m["key"] == market)).alias("_m"))
    return markets.select("id", "date", "home_team", "away_team", F.col("_b.key").alias("book"), F.explode("_m.outcomes").alias("_o")).select(
        "id", "date", "home_team", "away_team", "book", F.col("_o.name").alias("outcome"), F.col("_o.price").alias("price")
    )


def wide_odds(long: DataFrame, books: Sequence[str], keys: Sequence[str] = ("date", "home_team", "away_team", "outcome")) -> DataFrame:
    """One row per event and outcome, one mean-price column per listed book."""
    return long.groupBy(*keys).pivot("book", list(books)).agg(F.avg("price"))


def parsed_json(df: DataFrame, text: str, schema: str, out: str = "doc") -> DataFrame:
    return df.withColumn(out, F.from_json(text, schema))


def edge_rows(documents: DataFrame, doc: str = "doc", key: Sequence[str] = ()) -> DataFrame:
    """Edge/node document to one row per node and book; nodes without odds stay."""
    nodes = documents.select(*key, F.explode(F.col(f"{doc}.edges")).alias("_e")).select(*key, F.col("_e.node").alias("_n"))
    name = lambda n: F.concat_ws(" ", F.col(f"_n.fighter{n}.firstName"), F.col(f"_n.fighter{n}.lastName"))
    return nodes.select(*key, F.col("_n.id").alias("id"), name(1).alias("a"), name(2).alias("b"), F.explode_outer("_n.odds").alias("_o")).select(
        *key, "id", "a", "b", F.col("_o.book").alias("book"), F.col("_o.odds1").alias("odds_a"), F.col("_o.odds2").alias("odds_b")
    )


def json_number(text: Column | str, path: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.get_json_object(c, path).try_cast("double")


def latest_snapshots(documents: DataFrame, snapshot: str, key: str = "id") -> DataFrame:
    """Last snapshot of every event."""
    from duelframe.operators.clean import last_per_key

    return last_per_key(documents, [key], [snapshot])
