"""Byte strings that occur more than once anywhere, by deep-shallow sorting of anchored suffixes.

Sorting the suffix of every byte is not needed: equal windows choose the same anchor (their smallest m-gram) at the same
place, so it is enough to sort, per anchor, the suffixes that start at it and the reversed prefixes that end at it. Two
windows with ``o`` bytes before the anchor are equal exactly if their suffixes share window - o bytes and their
prefixes share o bytes, which the common prefixes of sorted neighbours tell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelframe.llm.arrays import _powers, chunks, list_column, mix64, prefix_sums, super_runs, text_bytes, whole_groups, U
from duelframe.llm.deep_shallow import deep_shallow_sort
from duelframe.llm.staging import TEXT_KEY, discard, is_empty, same_at_every_size, stage, text_rows

KEYS = ["doc_id", TEXT_KEY]
PART = 1 << 21


def _runs(batch: pa.RecordBatch, window: int, gram: int):
    """Runs of windows that share their anchor: first and last window, anchor, hash and row; long texts in overlapping parts."""
    data, offsets = text_bytes(batch)
    found = []
    for a in range(0, max(1, len(data) - window + 1), PART):
        part = data[a : a + PART + window - 1]
        if len(part) < window:
            break
        row = np.searchsorted(offsets, np.arange(a, a + len(part)), "right") - 1
        first, last, place, h = _anchor_runs(part, row, window, gram)
        found.append((first + a, last + a, place + a, h))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return data, offsets, none, none, none, none, none
    first, last, place, h = (np.concatenate(x) for x in zip(*found))
    return data, offsets, first, last, place, h.view(np.int64), np.searchsorted(offsets, first, "right") - 1


def _anchor_runs(data: np.ndarray, row: np.ndarray, window: int, gram: int):
    p = prefix_sums(data)
    down = _powers(len(data) + 1)[1]
    n = len(data) - gram + 1
    return super_runs(data, row, window, gram, mix64((p[gram:] - p[:n]) * down[:n]))


def _anchor_counts(window: int, gram: int):
    def run(batches):
        for batch in chunks(batches):
            h = _runs(batch, window, gram)[5]
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in chunks(batches):
            *_, h, of = _runs(batch, window, gram)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
            h, of = h[new], of[new]
            keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[of]) for c in KEYS]
            yield pa.RecordBatch.from_arrays([pa.array(h), *keys], ["h", *KEYS])

    return run


def _pieces(window: int, gram: int):
    """Byte strings around wanted anchors. A string that recurs within the chunk carries its bytes once."""
    def run(batches):
        for batch in chunks(batches):
            data, offsets, first, last, place, h, of = _runs(batch, window, gram)
            wanted = batch.column("wanted")
            hit = np.zeros(len(h), dtype=bool)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            for r in range(batch.num_rows):
                a, b = edges[r], edges[r + 1]
                if a < b:
                    hit[a:b] = np.isin(h[a:b], wanted[r].values.to_numpy(zero_copy_only=False))
            at = np.flatnonzero(hit)
            raw, seen, packed, names = data.tobytes(), set(), [], []
            for s, e, o in zip(first[at].tolist(), (last[at] + window).tolist(), place[at].tolist()):
                piece = raw[s:e]
                name = hashlib.md5(piece + (o - s).to_bytes(4, "big")).digest()
                packed.append(None if name in seen else piece)
                seen.add(name)
                names.append(name)
            keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[of[at]]) for c in KEYS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at]), pa.array(names, pa.binary()), pa.array(packed, pa.binary()), *keys,
                 pa.array(first[at] - offsets[of[at]]), pa.array((place[at] - first[at]).astype(np.int32))],
                ["h", "name", "packed", *KEYS, "start", "before"],
            )

    return run


def repeated_offsets(pieces: list[bytes], before: list[int], copies: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Per byte string the ranges of o (bytes before the anchor) whose window occurs more than once in the bucket.

    ``before`` is the anchor's place in each string, ``copies`` how often the string occurs.
    """
    n = len(pieces)
    low = [window - (len(p) - b) for p, b in zip(pieces, before)]
    if n == 1:
        return [[(low[0], before[0])] if copies[0] > 1 else []]
    right, r_shared = deep_shallow_sort([p[b:] for p, b in zip(pieces, before)])
    left, l_shared = deep_shallow_sort([p[:b][::-1] for p, b in zip(pieces, before)])
    if n == 2:
        out = []
        for i in range(2):
            if copies[i] > 1:
                out.append([(low[i], before[i])])
            else:
                a, b = max(low[i], window - r_shared[1]), min(before[i], l_shared[1])
                out.append([(a, b)] if a <= b else [])
        return out
    r_shared, l_shared, times = np.array(r_shared), np.array(l_shared), np.array(copies)
    least, most = np.array(low), np.array(before)
    edges = np.unique(np.concatenate([window - r_shared[1:], l_shared[1:] + 1, [least.min()]]))
    edges = edges[(edges >= least.min()) & (edges <= most.max())]
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    r_class, l_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o, end in zip(edges.tolist(), [*(edges[1:] - 1).tolist(), int(most.max())]):
        r_class[right] = np.cumsum(r_shared < window - o)
        l_class[left] = np.cumsum(l_shared < o)
        inside = (least <= end) & (most >= o)
        _, which = np.unique(r_class * (n + 1) + l_class, return_inverse=True)
        total = np.bincount(which, weights=times * inside)
        for i in np.flatnonzero(inside & (total[which] > 1)).tolist():
            a, b = max(o, low[i]), min(end, before[i])
            if a <= b:
                if out[i] and out[i][-1][1] == a - 1:
                    out[i][-1] = (out[i][-1][0], b)
                else:
                    out[i].append((a, b))
    return out


def _bucket_ranges(window: int):
    """Ranges of repeated windows in the strings of whole buckets, counted from each string's first window."""
    def run(batches):
        for group in whole_groups(batches, "h"):
            h = group.column("h").to_numpy()
            names, pieces, before, copies = (group.column(c).to_pylist() for c in ("name", "packed", "before", "copies"))
            edges = [*np.flatnonzero(np.append(True, h[1:] != h[:-1])).tolist(), len(h)]
            who, a_out, b_out = [], [], []
            for a, b in zip(edges, edges[1:]):
                for i, ranges in enumerate(repeated_offsets(pieces[a:b], before[a:b], copies[a:b], window), a):
                    if ranges:
                        who.append(i)
                        a_out.append([before[i] - y for _, y in ranges])
                        b_out.append([before[i] - x for x, _ in ranges])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[who]), pa.array([names[i] for i in who], pa.binary()), pa.array(a_out, pa.list_(pa.int32())), pa.array(b_out, pa.list_(pa.int32()))],
                ["h", "name", "low", "high"],
            )

    return run


def _single_windows(window: int):
    """Every window of every string of a hot bucket as a row, named by its SHA-256."""
    def run(batches):
        for batch in chunks(batches, "packed", 1 << 16):
            row, place, digest = [], [], []
            for i, piece in enumerate(batch.column("packed").to_pylist()):
                for j in range(len(piece) - window + 1):
                    row.append(i)
                    place.append(j)
                    digest.append(hashlib.sha256(piece[j : j + window]).digest())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("h").take(take), batch.column("name").take(take), batch.column("copies").take(take), pa.array(place, pa.int32()), pa.array(digest, pa.binary())],
                ["h", "name", "copies", "place", "digest"],
            )

    return run


def _removed(window: int):
    def run(batches):
        for batch in chunks(batches):
            out: list[tuple] = []
            firsts, lasts = batch.column("firsts"), batch.column("lasts")
            for i, text in enumerate(batch.column("text")):
                raw = text.as_py().encode()
                gone, end, kept, cuts = 0, 0, [], []
                if firsts[i].is_valid:
                    a = firsts[i].values.to_numpy(zero_copy_only=False)
                    b = lasts[i].values.to_numpy(zero_copy_only=False) + window
                    order = np.argsort(a, kind="stable")
                    for s, e in zip(a[order].tolist(), b[order].tolist()):
                        if cuts and s <= cuts[-1][1]:
                            cuts[-1][1] = max(cuts[-1][1], e)
                        else:
                            cuts.append([s, e])
                for s, e in cuts:
                    kept.append(raw[end:s])
                    gone, end = gone + e - s, e
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((len(raw), gone, len(cuts), left, [x[0] for x in cuts], [x[1] for x in cuts], hashlib.sha256(left).hexdigest()))
            n, gone, cuts, left, s, e, sha = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.int64()), pa.array(left, pa.binary()),
                 pa.array(s, pa.list_(pa.int64())), pa.array(e, pa.list_(pa.int64())), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "span_starts", "span_ends", "kept_sha256"],
            )

    return run


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 80, bucket_rows: int = 2_000) -> DataFrame:
    """Per document the ranges of starts of ``window``-byte strings that also start anywhere else.

    Anchors that occur once cannot hold a repeated window; their text never travels. Equal strings around an anchor are
    combined before the shuffle. A bucket of more than ``bucket_rows`` different strings is not sorted in one task: its
    windows are spread by their own content. Both ways give the same ranges.
    """
    rows = text_rows(docs, id_col, text_col)
    key_type = f"doc_id long, {TEXT_KEY} long"
    counts = rows.mapInArrow(_anchor_counts(window, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = stage(counts.where("n > 1").select("h"), "shared-anchors")
    places = rows.mapInArrow(_anchors(window, gram), f"h long, {key_type}").join(shared, "h", "left_semi")
    wanted = stage(places.groupBy(*KEYS).agg(F.collect_set("h").alias("wanted")), "wanted-anchors")
    cut = rows.join(same_at_every_size(wanted), KEYS).select(*KEYS, "text", "wanted")
    pieces = stage(cut.mapInArrow(_pieces(window, gram), f"h long, name binary, packed binary, {key_type}, start long, before int"), "anchored-strings")
    discard(shared, wanted)
    different = stage(
        pieces.groupBy("h", "name").agg(F.count(F.lit(1)).alias("copies"), F.max("packed").alias("packed"), F.max("before").alias("before")), "different-strings"
    )
    sizes = stage(different.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all")).where("all > 1").select("h", "n"), "bucket-sizes")
    hot = sizes.where(F.col("n") > bucket_rows).select("h")
    buckets = different.join(sizes.where(F.col("n") <= bucket_rows), "h").select("h", "name", "packed", "before", "copies")
    ranges = buckets.repartition("h").sortWithinPartitions("h").mapInArrow(_bucket_ranges(window), "h long, name binary, low array<int>, high array<int>")
    if not is_empty(hot):
        single = different.join(hot, "h", "left_semi").select("h", "name", "copies", "packed").mapInArrow(
            _single_windows(window), "h long, name binary, copies long, place int, digest binary")
        again = single.groupBy("digest").agg(F.sum("copies").alias("all")).where("all > 1").select("digest")
        spread = single.join(again, "digest").groupBy("h", "name").agg(F.collect_list("place").alias("low"))
        ranges = ranges.unionByName(spread.withColumn("high", F.col("low")))
    found = pieces.drop("packed").join(ranges, ["h", "name"]).select(
        *KEYS, F.expr("transform(low, x -> start + x)").alias("firsts"), F.expr("transform(high, x -> start + x)").alias("lasts")
    )
    lists = found.groupBy(*KEYS).agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))
    lists = stage(lists, "repeated-ranges")
    discard(pieces, different, sizes)
    return lists


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_bytes, span_starts, span_ends, kept_sha256.

    Every byte covered by a ``window``-byte string that also starts elsewhere, in the same document or another, is
    removed, first occurrences included; strings are judged on the input and never cross documents. A null text is
    empty; shorter texts lose nothing. Repeated rows are documents of their own and so remove each other. Rows with a
    null id take no part and keep all bytes. An empty table gives an empty result.
    """
    lists = repeated_ranges(docs, id_col, text_col, window, **options)
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, span_starts array<long>, span_ends array<long>, kept_sha256 string")
    named = text_rows(docs, id_col, text_col).join(same_at_every_size(lists), KEYS, "left").select("doc_id", "text", "firsts", "lasts")
    unnamed = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lit(None).cast("array<long>").alias("firsts"), F.lit(None).cast("array<long>").alias("lasts"))
    return named.unionByName(unnamed).mapInArrow(_removed(window), schema)
