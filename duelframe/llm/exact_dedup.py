"""Exact duplicates by 128-bit content hash, with a byte comparison inside every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.llm.staging import is_empty, stage


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=lambda text: text, digest=content_hash,
) -> DataFrame:
    """One row per document with the id that its group of equal texts keeps.

    Rows are grouped by ``digest``; counts and the kept id are combined map-side, so a text that owns a third of all
    rows arrives as one row per task. Groups of more than one row are then checked byte for byte: equal smallest and
    largest text means that all texts are equal. A digest whose texts differ (a collision) is split by the text itself.

    A null text counts as empty. Equal ids tie: rows repeating id and text all name that id as the kept one.
    A null id is smaller than every other; a group of null ids only keeps null. Other columns are ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.withColumn("h", digest(F.col("text")))
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    repeated = stage(groups.where("group_size > 1").select("h"), "repeated-hashes")
    compared = rows.select("h", "text").join(repeated, "h", "left_semi").groupBy("h").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    collided = stage(compared.where("low <> high").select("h"), "collided-hashes")
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    if is_empty(collided):
        rows = rows.drop("text")
        split, keys = groups, ["h"]
    else:
        hit = collided.withColumn("_hit", F.lit(True))
        rows = rows.join(hit, "h", "left").withColumn("part", F.when(F.col("_hit"), F.col("text")).otherwise(F.lit(""))).drop("_hit", "text")
        keys = ["h", "part"]
        split = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
    return rows.join(split, keys).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat the kept id and its text are copies too: one of them stays. Rows with a null id are told apart by
    their text alone; one stays where no other row has that text.
    """
    found = exact_duplicates(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    winners = stage(found.groupBy("_id", "_sha").count(), "kept-documents")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    marked = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_sha", sha)
    on = marked["_id"].eqNullSafe(winners["_id"]) & (marked["_sha"] == winners["_sha"])
    kept = marked.join(winners, on).select(*[marked[c] for c in docs.columns], marked["_id"], marked["_sha"], winners["count"].alias("_rows"))
    if not is_empty(winners.where("count > 1")):
        kept = kept.where("_rows = 1").unionByName(kept.where("_rows > 1").dropDuplicates(["_id", "_sha"]))
    return kept.select(*docs.columns)
