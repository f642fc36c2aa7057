"""Ranked lexical search by pipelined term partitioning.

Terms are owned by stages, the most telling terms by the first. A bundle holds some items and, for one shard of the
documents, a sparse table of accumulators (item, document, score so far). It travels through the stages one after the
other: each cogroups the bundles with the postings its terms have in the same shard, adds whole-number contributions, and
passes on what can still be among the best. The last stage selects.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from duelframe.llm.arrays import chunks, list_column, lower_ascii, spans, text_bytes
from duelframe.llm.spelling import lower_ascii as lower_ascii_text
from duelframe.llm.staging import discard, stage, text_rows

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SHARD_BITS = 14  # documents of a shard: a bundle's dense table stays at items x 16,384 numbers
BUNDLE = 128
MOST = 1_000_000  # no contribution reaches its term's weight times this
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOUND = "bundle int, shard long, item array<int>, place array<int>, doc array<long>, score array<long>, top_item array<int>, top_score array<long>"


def tokens(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows' texts, in order, and the row of each."""
    data, offsets = text_bytes(batch)
    data = lower_ascii(data)
    starts, ends, row = spans(_LETTER[data], offsets)
    edges = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    joined = np.ascontiguousarray(data[_LETTER[data]])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(joined)]), row


def _forward(terms: list[bytes]):
    """Number of terms of every document, and which of the wanted terms it holds how often."""
    wanted = pa.array(terms, pa.large_binary())

    def run(batches):
        for batch in chunks(batches):
            found, row = tokens(batch)
            at = pc.fill_null(pc.index_in(found, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = at >= 0
            pair, times = np.unique(row[hit] * len(terms) + at[hit], return_counts=True)
            held = np.bincount(pair // max(1, len(terms)), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64()),
                 list_column(pa.array((pair % max(1, len(terms))).astype(np.int32)), held), list_column(pa.array(times.astype(np.int64)), held)],
                ["doc_id", "n", "terms", "times"])

    return run


def contributions(times: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """A posting's contribution before its weight: (1000000000 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L."""
    m = 25 + (75 * n * total_docs) // total_terms
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def _postings(owned: np.ndarray, bundle_terms: np.ndarray, total_docs: int, total_terms: int):
    """Postings of the owned terms by bundle and shard, many in one row."""
    def run(batches):
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                held = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b - a), held)
                term = part.column("terms").flatten().to_numpy()
                keep = owned[term] if len(term) else np.zeros(0, dtype=bool)
                row, term, times = row[keep], term[keep], part.column("times").flatten().to_numpy()[keep]
                share = contributions(times, part.column("n").to_numpy()[row], total_docs, total_terms)
                place, doc = part.column("place").to_numpy(), part.column("doc_id").to_numpy()
                for k in range(len(bundle_terms)):
                    mine = bundle_terms[k][term] if len(term) else keep
                    if mine.any():
                        r = row[mine]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k], pa.int32()), pa.array([shard[a]], pa.int64()), *(list_column(pa.array(x, t), np.array([len(r)])) for x, t in (
                                (place[r], pa.int32()), (doc[r], pa.int64()), (term[mine], pa.int32()), (share[mine], pa.int64())))],
                            ["bundle", "shard", "place", "doc", "term", "share"])

    return run


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(table.column(name).combine_chunks()).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, dtype=np.int64)


def _advance(query: dict[int, list[tuple[int, int]]], owned: np.ndarray, weight: np.ndarray, left: np.ndarray, before: np.ndarray, floor: np.ndarray, most: int, last: bool):
    """One stage for one bundle and shard.

    ``query`` has each item's (term, count), ``left`` and ``before`` bound what an item's later terms, and the terms from
    this stage on, can still add; ``floor`` is a score that ``most`` documents are known to have reached.
    """
    def run(key, bundles: pa.Table, postings: pa.Table):
        bundle = key[0].as_py()
        term = _flat(postings, "term")
        order = np.argsort(term, kind="stable")
        term = term[order]
        place, doc = _flat(postings, "place")[order], _flat(postings, "doc")[order]
        gain = _flat(postings, "share")[order] * weight[term] if len(term) else np.zeros(0, dtype=np.int64)
        held_item, held_place, held_doc, held_score = (_flat(bundles, c) for c in ("item", "place", "doc", "score"))
        names = np.zeros(1 << SHARD_BITS, dtype=np.int64)
        names[place] = doc
        names[held_place] = held_doc
        rest, out, tops = np.argsort(held_item, kind="stable"), [], []
        held_item = held_item[rest]
        for item in (i for i in query if i // BUNDLE == bundle):
            a, b = np.searchsorted(held_item, [item, item + 1])
            score = np.zeros(1 << SHARD_BITS, dtype=np.int64)
            score[held_place[rest[a:b]]] = held_score[rest[a:b]]
            known = score > 0
            for t, count in query[item]:
                if owned[t]:
                    x, y = np.searchsorted(term, [t, t + 1])
                    score[place[x:y]] += gain[x:y] * count  # a document holds a term once, so places differ
            if before[item] < floor[item]:
                score[~known] = 0  # a document first met here cannot be among the best any more
            at = np.flatnonzero(score)
            if not len(at):
                continue
            value = score[at]
            least = floor[item]
            if len(at) > most:
                least = max(least, np.partition(value, len(value) - most)[len(value) - most])
            keep = value + left[item] >= least
            at, value = at[keep], value[keep]
            best = np.lexsort((names[at], -value))[:most]
            if last:
                at, value = at[best], value[best]
                best = slice(None)
            out.append((np.full(len(at), item), at, names[at], value))
            tops.append((np.full(len(value[best]), item), value[best]))
        joined = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (zip(*out) if out else [()] * 4)]
        heads = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (zip(*tops) if tops else [()] * 2)]
        one = lambda x, t: list_column(pa.array(x, t), np.array([len(x)]))
        return pa.Table.from_arrays(
            [pa.array([bundle], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *(one(x, t) for x, t in zip([*joined, *heads], (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())))],
            ["bundle", "shard", "item", "place", "doc", "score", "top_item", "top_score"])

    return run


def _owners(weight: np.ndarray, times: np.ndarray, stages: int) -> np.ndarray:
    """The stage of every term: heavier terms first, each stage with about four times the postings of the one before."""
    order = np.argsort(-weight, kind="stable")
    done = np.cumsum(times[order]) / max(1, times.sum())
    share = np.cumsum(4.0 ** np.arange(stages))
    out = np.empty(len(weight), dtype=np.int64)
    out[order] = np.minimum(np.searchsorted(share / share[-1], done, "left"), stages - 1)
    return out


def _search(docs: DataFrame, asked: list, ids: list, most: int, stages: int) -> DataFrame | None:
    """The best documents of a part of the items; ``asked`` has (item number, term, count)."""
    spark = docs.sparkSession
    terms = sorted({t for _, t, _ in asked})
    number = {t: k for k, t in enumerate(terms)}
    forward = text_rows(docs).mapInArrow(_forward(terms), "doc_id long, n long, terms array<int>, times array<long>")
    forward = stage(forward.withColumn("row", F.monotonically_increasing_id()), "search-forward")
    total_docs, total_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["term"]] = r["df"]  # one row for a term of the items
    if not df.any():
        discard(forward)
        return None
    weight = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df], dtype=np.int64)
    stages = max(1, min(stages, int((weight > 0).sum())))
    owner = _owners(weight, df, stages)
    query: dict[int, list[tuple[int, int]]] = {}
    rest = np.zeros((stages + 1, len(ids)), dtype=np.int64)
    bundle_terms = np.zeros((-(-len(ids) // BUNDLE), len(terms)), dtype=bool)
    for item, term, count in asked:
        t = number[term]
        if weight[t] > 0:
            query.setdefault(item, []).append((t, count))
            rest[: owner[t] + 1, item] += weight[t] * count * MOST
            bundle_terms[item // BUNDLE, t] = True
    placed = forward.select("doc_id", "n", "terms", "times", F.shiftright("row", SHARD_BITS).alias("shard"), (F.col("row").bitwiseAND((1 << SHARD_BITS) - 1)).cast("int").alias("place"))
    bundles, floor = spark.createDataFrame([], FOUND), np.zeros(len(ids), dtype=np.int64)
    for k in range(stages):
        owned = (owner == k) & (weight > 0)
        postings = placed.mapInArrow(_postings(owned, bundle_terms, total_docs, total_terms), "bundle int, shard long, place array<int>, doc array<long>, term array<int>, share array<long>")
        step = _advance(query, owned, weight, rest[k + 1], rest[k], floor, most, k == stages - 1)
        after = stage(bundles.groupBy("bundle", "shard").cogroup(postings.groupBy("bundle", "shard")).applyInArrow(step, FOUND), "search-bundles")
        if k:
            discard(bundles)
        bundles = after
        if k < stages - 1:
            heads = bundles.select(F.explode(F.arrays_zip("top_item", "top_score")).alias("h")).select("h.*")
            place = F.row_number().over(Window.partitionBy("top_item").orderBy(F.desc("top_score")))
            for r in heads.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") == most).collect():
                floor[r["top_item"]] = r["top_score"]  # one row an item
    discard(forward)
    return bundles.select(F.explode(F.arrays_zip("item", "doc", "score")).alias("f")).select(F.col("f.item").alias("item"), F.col("f.doc").alias("doc_id"), F.col("f.score").alias("score"))


def ranked_search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = 10, stages: int = 3, dictionary_bytes: int = 1 << 20,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents with a score above 0 for every item, equal scores by id.

    The score is a sum of whole numbers over the item's terms, repeats included, so it does not depend on order or layout.
    A document is dropped on the way only when a bound proves that ``most`` others stay ahead of it, so every stage is exact.

    The items' terms go to all tasks. Where they exceed ``dictionary_bytes``, the items are dealt by hash into parts
    of about that size and each part searches all documents: same result, more passes.

    A null or empty text has no terms: such a document counts nowhere, such an item gets no rows. Rows without an id are
    left out. A repeated document row is a document of its own and ranks again; item rows that share an id are searched
    with all their different texts together. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    words = texts.select("item_id", F.explode(F.regexp_extract_all(lower_ascii_text(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    counted = stage(words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "search-items")
    size = counted.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-size // dictionary_bytes))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    schema = f"item int, item_id {kind.simpleString()}"
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    for part in range(parts):
        rows = counted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about dictionary_bytes
        ids = sorted({r["item_id"] for r in rows})
        if not ids:
            continue
        at = {x: k for k, x in enumerate(ids)}
        best = _search(plain, sorted((at[r["item_id"]], r["term"].encode(), r["times"]) for r in rows), ids, most, stages)
        if best is not None:
            named = spark.createDataFrame(list(enumerate(ids)), schema)
            found = found.unionByName(best.join(F.broadcast(named), "item").select("item_id", "doc_id", "score"))
    discard(counted)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
