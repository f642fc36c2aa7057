"""How a registered query is described, and the shared example data model.

Every query runs an operator on whole tables of the star schema and names the
SQL that must give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.plans.sizing import Folder


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}


def expand(sql: str) -> str:
    """Replace r2(x), r4(x), r6(x) by the same floating-point steps that ``rounded`` takes."""
    while hit := re.search(r"\br([246])\(", sql):
        depth, at = 1, hit.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        scale = f"1e{hit.group(1)}::DOUBLE"
        sql = f"{sql[:hit.start()]}(floor(({sql[hit.end():at - 1]}) * {scale} + 0.5::DOUBLE) / {scale}){sql[at:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""
    def register(fn):
        CATALOG[name] = Query(fn, expand(sql) if sql else None)
        return fn

    return register


def r(c: Column | str, digits: int = 4) -> Column:
    """Rounding with the same floating-point steps in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    scale, todo = f"{10.0**digits}D", set(columns)
    return df.selectExpr(*[f"floor(`{c}` * {scale} + 0.5D) / {scale} AS `{c}`" if c in todo else f"`{c}`" for c in df.columns])


# ---------------------------------------------------------------- matches drawn from orders

def matches(t: Tables) -> DataFrame:
    """Head-to-head matches: an order whose first and last line come from different suppliers.

    The first and last line are found with min/max of a struct, combined map-side.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    ends = t.lineitem.groupBy("l_orderkey").agg(F.min(line).alias("x"), F.max(line).alias("y"))
    orders = t.orders.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("ts"), "o_orderpriority", "o_orderstatus", "o_totalprice"
    )
    kind = (
        F.when(F.col("o_orderstatus") == "F", "ko").when(F.col("o_orderstatus") == "O", "subw")
        .when(F.col("x.l_returnflag") == "A", "udec").when(F.col("x.l_returnflag") == "N", "sdec").otherwise("mdec")
    )
    base = (
        ends.where(F.col("x.l_suppkey") != F.col("y.l_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("match_id"), F.col("o_orderpriority").alias("league"), "ts",
            F.col("x.l_suppkey").alias("a"), F.col("y.l_suppkey").alias("b"),
            F.when(F.col("x.l_extendedprice") > F.col("y.l_extendedprice"), 1.0).otherwise(0.0).alias("score"),
            kind.alias("kind"),
            (1 + F.col("x.l_linenumber") % 3).cast("int").alias("round"), F.lit("3 Rnd (5-5-5)").alias("time_format"),
            F.floor(F.col("x.l_quantity") / 10).cast("int").alias("natural_class"),
            F.floor(F.col("y.l_quantity") / 10).cast("int").alias("opp_natural_class"),
            F.lit(3).alias("fought_class"),
            (F.col("o_totalprice") > 400000).cast("int").alias("title_fight"),
            F.when(F.col("o_totalprice") > 400000, "Title match").otherwise("Match").alias("label"),
            F.col("x.l_quantity").alias("landed"), (F.col("x.l_discount") * 400 + 5).alias("absorbed"),
            F.col("y.l_quantity").alias("opp_landed"), (F.col("y.l_discount") * 400 + 5).alias("opp_absorbed"),
            F.lit(50.0).alias("attempts"), F.lit(50.0).alias("opp_attempts"),
            F.round(F.col("x.l_tax") * 100).alias("tdavg"), F.round(F.col("x.l_discount") * 100).alias("subavg"), F.col("x.l_quantity").alias("tddef"),
            F.round(F.col("y.l_tax") * 100).alias("opp_tdavg"), F.round(F.col("y.l_discount") * 100).alias("opp_subavg"), F.col("y.l_quantity").alias("opp_tddef"),
        )
    )
    won = F.col("score") == 1
    flags = {}
    for ach, con in (("ko", "kod"), ("subw", "subwd"), ("udec", "udecd"), ("sdec", "sdecd"), ("mdec", "mdecd")):
        flags[ach] = (won & (F.col("kind") == ach)).cast("int")
        flags[con] = (~won & (F.col("kind") == ach)).cast("int")
    return base.withColumns(flags)


MATCHES_SQL = """
lines AS (
  SELECT *, row_number() OVER up AS first_no, row_number() OVER down AS last_no
  FROM lineitem
  WINDOW up AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag),
         down AS (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC)
),
matches AS (
  SELECT o_orderkey AS match_id, o_orderpriority AS league, CAST(o_orderdate AS DATE) AS ts,
         x.l_suppkey AS a, y.l_suppkey AS b,
         CASE WHEN x.l_extendedprice > y.l_extendedprice THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
         CASE WHEN o_orderstatus = 'F' THEN 'ko' WHEN o_orderstatus = 'O' THEN 'subw'
              WHEN x.l_returnflag = 'A' THEN 'udec' WHEN x.l_returnflag = 'N' THEN 'sdec' ELSE 'mdec' END AS kind,
         1 + x.l_linenumber % 3 AS round,
         CAST(floor(x.l_quantity / 10) AS INT) AS natural_class, CAST(floor(y.l_quantity / 10) AS INT) AS opp_natural_class,
         CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS title_fight,
         x.l_quantity AS landed, x.l_discount * 400 + 5 AS absorbed, y.l_quantity AS opp_landed, y.l_discount * 400 + 5 AS opp_absorbed,
         round(x.l_tax * 100) AS tdavg, round(x.l_discount * 100) AS subavg, x.l_quantity AS tddef,
         round(y.l_tax * 100) AS opp_tdavg, round(y.l_discount * 100) AS opp_subavg, y.l_quantity AS opp_tddef
  FROM lines x JOIN lines y ON x.l_orderkey = y.l_orderkey AND x.first_no = 1 AND y.last_no = 1
  JOIN orders ON o_orderkey = x.l_orderkey
  WHERE x.l_suppkey <> y.l_suppkey
)
"""


FLAGS = ["ko", "kod", "subw", "subwd", "udec", "udecd", "sdec", "sdecd", "mdec", "mdecd"]


def sides(t: Tables) -> DataFrame:
    """One row per match and side with integer counting stats, the input of the feature families."""
    return _both_sides(matches(t))


def written_sides(t: Tables) -> DataFrame:
    """``sides`` of matches that are written once, for features that count the entities' rows before they use them."""
    m, store = matches(t).select(
        "match_id", "ts", "a", "b", "score", "round", "fought_class", "landed", "opp_landed", "tdavg", "opp_tdavg", "subavg", "opp_subavg",
        "natural_class", "opp_natural_class", *FLAGS), Folder(t.spark, "matches")
    store.write(m, "rows")
    return _both_sides(store.read("rows", m.schema))


def _both_sides(m: DataFrame) -> DataFrame:
    opposite = {"ko": "kod", "subw": "subwd", "udec": "udecd", "sdec": "sdecd", "mdec": "mdecd"}
    opposite.update({v: k for k, v in opposite.items()})

    def side(me, opp, won, own, other, fl):
        return F.struct(
            F.col(me).alias("entity"), F.col(opp).alias("opp_entity"), won.cast("int").alias("win"), (1 - won).cast("int").alias("loss"),
            F.col(f"{own}landed").cast("int").alias("sigstracc"), F.col(f"{other}landed").cast("int").alias("sigstrabs"),
            F.lit(50).alias("sigstratt"), F.lit(50).alias("sigstrattfromopp"),
            F.col(f"{own}tdavg").cast("int").alias("tdacc"), F.lit(8).alias("tdatt"),
            F.col(f"{other}tdavg").cast("int").alias("tdabs"), F.lit(8).alias("tdattfromopp"),
            F.col(f"{own}subavg").cast("int").alias("subatt"),
            F.col(f"{own}natural_class").alias("kd"), F.col(f"{other}natural_class").alias("kdd"),
            *[F.col(fl(f)).alias(f) for f in FLAGS],
        )

    rows = m.select("match_id", "ts", (F.col("round") * 5 - 5).cast("int").alias("fight_time_minutes"),
                    F.col("fought_class").alias("weight_of_fight"), F.explode(F.array(
                        side("a", "b", F.col("score"), "", "opp_", lambda f: f),
                        side("b", "a", 1 - F.col("score"), "opp_", "", lambda f: opposite[f]),
                    )).alias("_s"))
    return rows.select("match_id", "ts", "fight_time_minutes", "weight_of_fight", "_s.*")


def _side_sql(me, opp, won, own, other) -> str:
    pairs = [("ko", "kod"), ("subw", "subwd"), ("udec", "udecd"), ("sdec", "sdecd"), ("mdec", "mdecd")]
    flags = ", ".join(
        f"CASE WHEN kind = '{k}' AND ({won}) = 1 THEN 1 ELSE 0 END AS {k}, CASE WHEN kind = '{k}' AND ({won}) = 0 THEN 1 ELSE 0 END AS {d}"
        for k, d in pairs
    )
    return f"""SELECT match_id, ts, round * 5 - 5 AS fight_time_minutes, 3 AS weight_of_fight, {me} AS entity, {opp} AS opp_entity,
      CAST({won} AS INT) AS win, CAST(1 - ({won}) AS INT) AS loss,
      CAST({own}landed AS INT) AS sigstracc, CAST({other}landed AS INT) AS sigstrabs, 50 AS sigstratt, 50 AS sigstrattfromopp,
      CAST({own}tdavg AS INT) AS tdacc, 8 AS tdatt, CAST({other}tdavg AS INT) AS tdabs, 8 AS tdattfromopp,
      CAST({own}subavg AS INT) AS subatt, {own}natural_class AS kd, {other}natural_class AS kdd, {flags} FROM matches"""


SIDES_SQL = MATCHES_SQL + ", sides AS (" + _side_sql("a", "b", "score", "", "opp_") + " UNION ALL " + _side_sql("b", "a", "1 - score", "opp_", "") + ")\n"
