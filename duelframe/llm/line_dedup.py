"""Repeated runs of lines, from a suffix array over line ids that prefix doubling sorts in Spark.

A rank is a place in the sorted order of all runs of one length. Ranks of runs twice as long come from sorting pairs of
ranks; only different pairs are sorted, so a pair that a third of all places share is one row of the sort. Places whose
pair is unique cannot start a repeated run and are left out of later rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from duelframe.llm.arrays import chunks
from duelframe.llm.staging import TEXT_KEY, same_at_every_size, stage, text_rows

KEYS = ["doc_id", TEXT_KEY]


def lines_of(text: str) -> list[bytes]:
    return text.encode().split(b"\n") if text else []


def _lines(batches):
    """(doc, place, 128-bit id) of every line."""
    for batch in chunks(batches):
        ids, counts = [], []
        for text in batch.column("text").to_pylist():
            lines = lines_of(text)
            ids += [hashlib.blake2b(x, digest_size=16).digest() for x in lines]
            counts.append(len(lines))
        of = np.repeat(np.arange(batch.num_rows), counts)
        place = np.arange(len(of)) - (np.cumsum(counts) - counts)[of] if len(of) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of)) for c in KEYS], pa.array(place.astype(np.int32)), pa.array(ids, pa.binary())], [*KEYS, "place", "line"])


def _numbered(columns: list[str]):
    """Rows of a sorted partition with the partition's number and their place in it."""
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(np.full(batch.num_rows, part, np.int32)), at], [*columns, "part", "at"])

    return run


def ranked(keys: DataFrame, what: str) -> DataFrame:
    """Different keys with their rank in the sorted order of all: sorted ranges, numbered, shifted by the rows before."""
    columns = keys.columns
    schema = ", ".join(f"{c} {t}" for c, t in keys.dtypes) + ", part int, at long"
    numbered = stage(keys.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(_numbered(columns), schema), what)
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before = keys.sparkSession.createDataFrame([(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)], "part int, before long")
    return numbered.join(F.broadcast(before), "part").select(*columns, (F.col("before") + F.col("at")).alias("rank"))


def suffix_classes(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """(doc, place, rank) of every place whose run of ``length`` lines starts at least twice; equal runs have equal rank."""
    places = text_rows(docs, id_col, text_col).mapInArrow(_lines, f"doc_id long, {TEXT_KEY} long, place int, line binary")
    again = places.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    order = ranked(again, "line-ranks")
    now = stage(places.join(order, "line").select(*KEYS, "place", "rank"), "line-places")
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        ahead = W.partitionBy(*KEYS).orderBy("place").rangeBetween(step, step)
        pairs = stage(now.withColumn("next", F.max("rank").over(ahead)).where("next IS NOT NULL"), "line-pairs")
        again = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rank").alias("this"), "next")
        order = ranked(again, "pair-ranks").withColumnRenamed("rank", "after").withColumnRenamed("this", "rank")
        now = stage(pairs.join(order, ["rank", "next"]).select(*KEYS, "place", F.col("after").alias("rank")), "line-places")
        depth += step
    return now


def _removed(length: int):
    def run(batches):
        for batch in chunks(batches):
            total, gone, kept, sha, runs = [], [], [], [], []
            starts = batch.column("starts")
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines = lines_of(text)
                out, cuts = set(), []
                if starts[i].is_valid:
                    for s in sorted(starts[i].as_py()):
                        if cuts and s <= cuts[-1][1]:
                            cuts[-1][1] = s + length
                        else:
                            cuts.append([s, s + length])
                    out = {j for a, b in cuts for j in range(a, b)}
                left = b"\n".join(x for j, x in enumerate(lines) if j not in out)
                total.append(len(lines))
                gone.append(len(out))
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
                runs.append([f"{a}-{b - 1}" for a, b in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.string()))],
                ["doc_id", "n_lines", "n_removed", "kept_text", "kept_sha256", "runs"])

    return run


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text, kept_sha256, runs (maximal removed runs, "first-last").

    The suffix array is sorted to the depth of ``min_lines``: its intervals with a common prefix of that many lines are
    the repeated runs, and windows of neighbouring places join into maximal ones. The first occurrence, by (id, line),
    stays; every line of a later one goes. Lines are compared by 128-bit digests of their bytes.

    A null or empty text has no lines. Rows with a null id take no part. Rows that repeat an id and its text count as
    one document; those that repeat the id alone are told apart by content. An empty table gives an empty result.
    """
    now = suffix_classes(docs, id_col, text_col, min_lines)
    first = now.groupBy("rank").agg(F.min(F.struct(*KEYS, "place")).alias("first"))
    later = now.join(first, "rank").where(F.struct(*KEYS, "place") > F.col("first"))
    starts = stage(later.groupBy(*KEYS).agg(F.collect_set("place").alias("starts")), "repeated-runs")
    schema = "doc_id long, n_lines long, n_removed long, kept_text string, kept_sha256 string, runs array<string>"
    named = text_rows(docs, id_col, text_col).join(same_at_every_size(starts), KEYS, "left").select("doc_id", "text", "starts")
    unnamed = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("starts"))
    return named.unionByName(unnamed).mapInArrow(_removed(min_lines), schema)
