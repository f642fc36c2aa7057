"""Repeated word windows, counted exactly in buckets of super-k-mers.

Consecutive k-word windows that share their minimising m-gram travel together as one packed string. A window's
minimiser depends on its own words only, so equal windows always meet in the bucket of that minimiser.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelframe.llm.arrays import U, chunks, list_column, span_hashes, spans, super_runs, text_bytes, whole_groups, words
from duelframe.llm.staging import TEXT_KEY, discard, is_empty, same_at_every_size, stage, text_rows

KEYS = ["doc_id", TEXT_KEY]


def _runs(batch: pa.RecordBatch, k: int, m: int):
    data, offsets = text_bytes(batch)
    starts, ends, row = words(data, offsets)
    first, last, _, h = super_runs(span_hashes(data, starts, ends), row, k, m)
    return data, starts, ends, row, first, last, h.view(np.int64)


def _minimiser_ranges(k: int, m: int):
    """Per chunk of texts: each minimiser with its smallest and largest document."""
    def run(batches):
        for batch in chunks(batches):
            *_, row, first, _, h = _runs(batch, k, m)
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[row[first]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(doc[at]), pa.array(doc[np.append(at[1:], len(h))[: len(at)] - 1])], ["h", "lo", "hi"])

    return run


def _minimisers(k: int, m: int):
    """The distinct minimisers of each document."""
    def run(batches):
        for batch in chunks(batches):
            *_, row, first, _, h = _runs(batch, k, m)
            of = row[first]
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
            h, of = h[new], of[new]
            keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[of]) for c in KEYS]
            yield pa.RecordBatch.from_arrays([pa.array(h), *keys], ["h", *KEYS])

    return run


def _packed(k: int, m: int):
    """Super-k-mers whose minimiser is in the row's ``wanted`` list, as strings of words joined by one space.

    A string that recurs within the chunk carries its words once; its 128-bit digest names it everywhere else.
    """
    def run(batches):
        for batch in chunks(batches):
            data, starts, ends, row, first, last, h = _runs(batch, k, m)
            wanted = batch.column("wanted")
            of = row[first]
            hit = np.zeros(len(h), dtype=bool)
            edges = np.searchsorted(of, np.arange(batch.num_rows + 1))
            for r in range(batch.num_rows):
                a, b = edges[r], edges[r + 1]
                if a < b:
                    hit[a:b] = np.isin(h[a:b], wanted[r].values.to_numpy(zero_copy_only=False))
            at = np.flatnonzero(hit)
            raw = data.tobytes()
            begin = np.searchsorted(row, np.arange(batch.num_rows))
            seen, packed, names = set(), [], []
            for s, e in zip(starts[first[at]].tolist(), ends[last[at] + k - 1].tolist()):
                piece = b" ".join(raw[s:e].split())
                name = hashlib.md5(piece).digest()
                packed.append(None if name in seen else piece)
                seen.add(name)
                names.append(name)
            keys = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[of[at]]) for c in KEYS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at]), pa.array(names, pa.binary()), pa.array(packed, pa.binary()), *keys, pa.array((first[at] - begin[of[at]]).astype(np.int32))],
                ["h", "name", "packed", *KEYS, "start"],
            )

    return run


def _windows(column: pa.Array, k: int) -> tuple[list[bytes], np.ndarray]:
    """All k-word windows of packed strings, and how many each string has."""
    data, offsets = text_bytes(pa.RecordBatch.from_arrays([column], ["text"]))
    starts, ends, row = spans(data != 0x20, offsets)
    ok = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, dtype=np.int64)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts[ok].tolist(), ends[ok + k - 1].tolist())], np.bincount(row[ok], minlength=len(column))


def _bucket_minima(k: int):
    """Sort the windows of whole buckets; for each packed string the smallest document of each of its windows."""
    def run(batches):
        for group in whole_groups(batches, "h"):
            for batch in group.combine_chunks().to_batches():
                lo, hi, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "n"))
                window, counts = _windows(batch.column("packed"), k)
                of = np.repeat(np.arange(batch.num_rows), counts)
                least = lo[of].copy()
                shared = np.flatnonzero(n[of] > 1).tolist()
                shared.sort(key=window.__getitem__)
                i = 0
                while i < len(shared):
                    j = i + 1
                    while j < len(shared) and window[shared[j]] == window[shared[i]]:
                        j += 1
                    if j > i + 1:
                        same = shared[i:j]
                        least[same] = least[same].min()
                    i = j
                keep = least < hi[of]
                place = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
                kept = np.bincount(of[keep], minlength=batch.num_rows)
                some = np.flatnonzero(kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h").take(pa.array(some)), batch.column("name").take(pa.array(some)),
                     list_column(pa.array(place[keep].astype(np.int32)), kept[some]), list_column(pa.array(least[keep]), kept[some])],
                    ["h", "name", "places", "least"],
                )

    return run


def _single_windows(k: int):
    """Every window of every packed string as a row of its own."""
    def run(batches):
        for batch in chunks(batches, "packed", 1 << 18):
            window, counts = _windows(batch.column("packed"), k)
            of = np.repeat(np.arange(batch.num_rows), counts)
            place = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
            start = batch.column("start").to_numpy(zero_copy_only=False)[of] + place
            keys = [batch.column(c).take(pa.array(of)) for c in KEYS]
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), *keys, pa.array(start.astype(np.int32))], ["window", *KEYS, "start"])

    return run


def _removed(k: int):
    """Word counts, removed words and the text that is left, of texts with the starts of their repeated windows."""
    def run(batches):
        for batch in chunks(batches):
            n_words, n_removed, kept, sha = [], [], [], []
            starts = batch.column("starts")
            for i, text in enumerate(batch.column("text")):
                w = text.as_py().encode().split()
                n_words.append(len(w))
                if starts[i].is_valid:
                    at = starts[i].values.to_numpy(zero_copy_only=False)
                    depth = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + k, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    w = [x for x, g in zip(w, gone) if not g]
                n_removed.append(n_words[-1] - len(w))
                kept.append(b" ".join(w))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, bucket_rows: int = 20_000) -> DataFrame:
    """Per document the starts of word windows that also start in a document with a smaller id.

    1. Minimisers are reduced map-side to (minimiser, smallest document, largest document); one that only a single
       document has cannot hold a repeated window and its text never travels.
    2. Super-k-mers of the others are cut out, equal strings are combined before the shuffle, and each bucket is sorted.
    3. A minimiser with more than ``bucket_rows`` different strings would be a hot bucket: its windows are spread one by
       one over all tasks by their own words instead. Both ways give the same windows.
    """
    rows = text_rows(docs, id_col, text_col)
    key_type = f"doc_id long, {TEXT_KEY} long"
    ranges = rows.mapInArrow(_minimiser_ranges(window, gram), "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared = stage(ranges.where("lo < hi").select("h"), "shared-minimisers")
    held = rows.mapInArrow(_minimisers(window, gram), f"h long, {key_type}").join(shared, "h", "left_semi")
    wanted = stage(held.groupBy(*KEYS).agg(F.collect_set("h").alias("wanted")), "wanted-minimisers")
    cut = rows.join(same_at_every_size(wanted), KEYS).select(*KEYS, "text", "wanted")
    pieces = stage(cut.mapInArrow(_packed(window, gram), f"h long, name binary, packed binary, {key_type}, start int"), "super-k-mers")
    discard(shared, wanted)
    different = stage(
        pieces.groupBy("h", "name").agg(F.max("packed").alias("packed"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "different-super-k-mers")
    places = stage(pieces.select("h", "name", *KEYS, "start"), "super-k-mer-places")
    discard(pieces)  # from here on the words of equal strings are kept once
    sizes = stage(different.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("h", "n"), "bucket-sizes")
    buckets = different.join(sizes.where(F.col("n") <= bucket_rows), "h").select("h", "name", "packed", "lo", "hi", "n")
    minima = buckets.repartition("h").sortWithinPartitions("h").mapInArrow(_bucket_minima(window), "h long, name binary, places array<int>, least array<long>")
    found = places.join(minima, ["h", "name"]).select(
        *KEYS, F.expr("transform(filter(arrays_zip(places, least), x -> x.least < doc_id), x -> start + x.places)").alias("starts")
    ).where("size(starts) > 0")
    hot = sizes.where(F.col("n") > bucket_rows).select("h")
    if not is_empty(hot):
        crowded = different.join(hot, "h", "left_semi").select("h", "name", "packed")
        single = places.join(crowded, ["h", "name"]).select("packed", *KEYS, "start").mapInArrow(_single_windows(window), f"window binary, {key_type}, start int")
        first = single.groupBy("window").agg(F.min("doc_id").alias("lo"))
        found = found.unionByName(single.join(first, "window").where("lo < doc_id").select(*KEYS, F.array("start").alias("starts")))
    starts = stage(found.groupBy(*KEYS).agg(F.flatten(F.collect_list("starts")).alias("starts")), "repeated-windows")
    discard(places, different, sizes)
    return starts


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words left, joined by one space), kept_sha256.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. Null or empty texts have no words; texts shorter than a window
    lose nothing. Rows with a null id neither lose words nor cause others to; rows that repeat an id are one document
    as far as "smaller id" goes. An empty table gives an empty result.
    """
    starts = repeated_windows(docs, id_col, text_col, window, **options)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    named = text_rows(docs, id_col, text_col).join(same_at_every_size(starts), KEYS, "left").select("doc_id", "text", "starts")
    unnamed = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("starts")
    )
    return named.unionByName(unnamed).mapInArrow(_removed(window), schema)
