"""Sources and sinks over the given tables: what is written is read back, and must be the table again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duelframe.catalog.base import Tables, query
from duelframe.plans.sizing import cut
from duelframe.session import ensure_checkpoint_dir
from duelframe.sources import odds_documents as od, tables as src


def _fresh(t: Tables, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, 'Order "' || o_orderpriority || '", of ' || o_custkey AS note, CAST(o_orderdate AS DATE) AS day FROM orders""")
def csv_round_trip(t):
    """Quotes, commas and two date formats through a CSV file with declared columns."""
    written = t.orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.concat(F.lit('Order "'), "o_orderpriority", F.lit('", of '), F.col("o_custkey").cast("string")).alias("note"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    path = _fresh(t, "csv")
    written.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return src.read_csv_dated(t.spark, path, src.text_schema("key", "note", "day"), {"day": ["MMMM d, yyyy", "yyyy-MM-dd"]})


@query("csv_rounded", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_quantity FROM lineitem")
def csv_rounded(t):
    path = _fresh(t, "rounded")
    src.write_csv(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), path, digits=2)
    return src.read_csv(t.spark, path, src.text_schema("l_orderkey", "l_linenumber", "l_quantity")).withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("matchup_list", """
SELECT trim(a) AS a, trim(b) AS b FROM (SELECT ' ' || c_name || ' ' AS a, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Customer of ' || c_nationkey END AS b FROM customer) WHERE trim(b) <> ''""")
def matchup_list(t):
    path = _fresh(t, "pairs")
    b = F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Customer of "), F.col("c_nationkey").cast("string")))
    t.customer.select(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("a"), b.alias("b")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return src.read_matchups(t.spark, path)


@query("table_replace_and_reset", "SELECT s_suppkey, s_name FROM supplier")
def table_replace_and_reset(t):
    """A table is written twice, gets derived columns, and is cut back to its base columns."""
    name = f"suppliers_{uuid.uuid4().hex}"
    src.replace_table(t.supplier.select("s_suppkey"), name)
    src.replace_table(t.supplier.withColumn("derived", F.col("s_acctbal") * 2), name)
    t.spark.table(name).where("derived > 0").createOrReplaceTempView(f"{name}_view")
    src.reset(t.spark, [f"{name}_view"], {name: ["s_suppkey", "s_name"]})
    out = cut(src.read_table(t.spark, name))
    t.spark.sql(f"DROP TABLE {name}")
    return out


@query("table_by_sql", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def table_by_sql(t):
    """A bucketed table, read by a statement that groups on the bucket key."""
    name = f"customers_{uuid.uuid4().hex}"
    src.replace_table(t.customer.select("c_custkey", "c_nationkey"), name, bucket_by=["c_nationkey"], buckets=4)
    out = cut(src.read_table(t.spark, f"SELECT c_nationkey, count(*) AS n FROM {name} GROUP BY c_nationkey"))
    t.spark.sql(f"DROP TABLE {name}")
    return out


@query("stage_round_trip", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def stage_round_trip(t):
    return src.write_stage(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), _fresh(t, "stage"), ["o_orderstatus"])


@query("odds_json_file", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS date, 'C' || o_custkey AS home_team, 'x' AS away_team, b.book AS book, 'C' || o_custkey AS outcome, o_totalprice + b.more AS price
FROM orders, (VALUES ('one', 0), ('two', 1)) AS b(book, more)""")
def odds_json_file(t):
    """Nested documents written as JSON lines, read with the declared shape and flattened; another market is left out."""
    home = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    outcome = lambda more: F.array(F.struct(home.alias("name"), (F.col("o_totalprice") + more).alias("price")))
    market = lambda key, more: F.struct(F.lit(key).alias("key"), outcome(more).alias("outcomes"))
    book = lambda key, more: F.struct(F.lit(key).alias("key"), F.array(market("h2h", more), market("totals", 9)).alias("markets"))
    documents = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("commence_time"), home.alias("home_team"), F.lit("x").alias("away_team"),
        F.array(book("one", 0), book("two", 1)).alias("bookmakers"))
    path = _fresh(t, "odds")
    documents.write.json(path)
    return od.long_odds(t.spark.read.schema(od.ODDS_SCHEMA).json(path))


@query("latest_document_snapshots", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_document_snapshots(t):
    rows = t.events.withColumn("_at", F.struct("ts", "event_id"))
    return od.latest_snapshots(rows, "_at", "user_id").select("user_id", "event_id", "value")
