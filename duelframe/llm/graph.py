"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelframe.llm.staging import discard, stage


def _settled(edges: DataFrame) -> bool:
    """Whether every node is the end of one link only or the end of none: all that is left are stars."""
    end = lambda node, up, down: F.struct(F.col(node).alias("node"), F.lit(up).alias("ups"), F.lit(down).alias("downs"))
    nodes = edges.select(F.inline(F.array(end("u", 1, 0), end("v", 0, 1)))).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return not nodes.agg(F.max((F.col("ups") + F.col("downs") > 1).cast("int"))).first()[0]


def stars(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b) but the smallest of each component: the smallest node that can be reached.

    Alternates the large-star and small-star steps: every node's larger neighbours, then its smaller ones, are tied to
    its smallest neighbour. The number of rounds grows with the logarithm of the largest component. Each round is a
    written table, so neither lineage nor driver memory grows. ``links`` is read several times in the first round and
    should be written, too; links may come twice.
    """
    edges, written = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "links", give_back=False)
        discard(*written)
        written = [edges]
        if _settled(edges):
            break
    table = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    table._stage_folder = edges._stage_folder
    return table
