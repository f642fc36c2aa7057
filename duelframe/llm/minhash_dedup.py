"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature coordinate k of a set is min over x of second((first(x) + k) mod 2^64): one permutation mixes the
shingles, the other one, shifted circularly by k, ranks them. Two permutations give all coordinates.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.llm.arrays import U, chunks, list_column, lower_ascii, mix64, shingle_hashes, span_hashes, text_bytes, words
from duelframe.llm.graph import stars
from duelframe.llm.staging import TEXT_KEY, discard, is_empty, row_key, same_at_every_size, stage, text_rows

KEYS = ["doc_id", TEXT_KEY]
FIRST, SECOND = U(0x51AFD7ED558CCD25), U(0xC4CEB9FE1A85EC53)
PIECE = 1 << 18
SLOTS = 1 << 20
PARITY = 512
FEW = 16
SALTS = [U(0x9E6C63D0676A9A99 * (2 * k + 1) & (2**64 - 1)) for k in range(6)]


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and the edges of the rows.

    With fewer words than ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    data, offsets = text_bytes(batch)
    data = lower_ascii(data)
    starts, ends, row = words(data, offsets)
    h = span_hashes(data, starts, ends)
    n_words = np.bincount(row, minlength=batch.num_rows)
    begin = np.cumsum(n_words) - n_words
    g = shingle_hashes(h, width)
    ok = row[: len(g)] == row[width - 1 : width - 1 + len(g)]
    value, of = [g[ok]], [row[: len(g)][ok]]
    for n in range(1, width):
        short = np.flatnonzero(n_words == n)
        if len(short):
            x = np.zeros(len(short), dtype=U)
            for j in range(n):
                x = mix64(x + h[begin[short] + j] + U(n))
            value.append(x)
            of.append(short)
    value, of = np.concatenate(value), np.concatenate(of)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))[: len(value)]
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(batch.num_rows + 1))


def signatures(value: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash signatures, one row of ``size`` coordinates per set; empty sets get the largest value."""
    out = np.full((len(edges) - 1, size), np.iinfo(U).max, dtype=U)
    x = mix64(value * FIRST)
    some = np.flatnonzero(np.diff(edges))
    for a in range(0, len(x), PIECE):  # pieces bound the memory of very long texts
        b = min(len(x), a + PIECE)
        rows = some[(edges[some] < b) & (edges[some + 1] > a)]
        at = np.maximum(edges[rows], a) - a
        for k in range(size):
            ranked = mix64((x[a:b] + U(k)) * SECOND)
            out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(ranked, at))
    return out


def parity_bits(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For every set 512 bits, each the parity of the items that fall on it, as eight numbers.

    Two sets differ in at least as many items as their bits differ in places.
    """
    rows = len(edges) - 1
    out = np.zeros((rows, PARITY // 64), dtype=np.int64)
    for a in range(0, rows, 1024):  # blocks bound the counts that are held at once
        b = min(rows, a + 1024)
        part = value[edges[a] : edges[b]]
        at = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])) * PARITY + (mix64(part ^ SALTS[0]) & U(PARITY - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=(b - a) * PARITY) & 1).astype(np.uint8).reshape(b - a, PARITY)
        out[a:b] = np.packbits(odd, axis=1).view(np.int64)
    return out


def _sketches(width: int, bands: int, rows: int):
    """Set size, a 128-bit digest of the set and the band hashes of each document."""
    def run(batches):
        for batch in chunks(batches):
            value, edges = shingle_sets(batch, width)
            n = np.diff(edges)
            digest = []
            for salt in (U(0x8CB92BA72F3D8DD7), U(0xA24BAED4963EE407)):
                total = np.concatenate([[U(0)], np.cumsum(mix64(value ^ salt))])
                digest.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
            sig = signatures(value, edges, bands * rows)
            band = np.zeros((len(n), bands), dtype=U)
            for r in range(rows):
                band = mix64(band + sig[:, r::rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(TEXT_KEY), pa.array(n), pa.array(digest[0]), pa.array(digest[1]),
                 list_column(pa.array(band.view(np.int64).ravel()), np.full(len(n), bands)), list_column(pa.array(parity_bits(value, edges).ravel()), np.full(len(n), PARITY // 64))],
                [*KEYS, "n", "d1", "d2", "bands", "bits"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for batch in chunks(batches):
            value, edges = shingle_sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("class"), list_column(pa.array(value.view(np.int64)), np.diff(edges))], ["class", "items"])

    return run


def _verified(percent: int):
    """Pairs of sets with 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return run


def _possible(percent: int, n1, c1, n2, c2) -> Column:
    """Whether two sets of n items, of which c occur elsewhere as well, can reach the threshold at all."""
    most = F.least(c1, c2)
    return most * 100 >= (n1 + n2 - most) * percent


def _alike(percent: int, n1, bits1, n2, bits2) -> Column:
    """Whether two sets can reach the threshold, given in how many parity bits they differ: that many items at least are in one set only."""
    apart = reduce(lambda a, b: a + b, [F.bit_count(bits1[k].bitwiseXOR(bits2[k])) for k in range(PARITY // 64)])
    twice = n1 + n2 - apart  # twice the largest intersection
    return twice * 100 >= (2 * (n1 + n2) - twice) * percent


def _live(members: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Members of buckets that are not one component yet and that may have a partner there.

    Adds the member's component, the bucket's size, its largest component and the number of members outside it. A member
    whose shared items cannot make a link even with the smallest set of the bucket is done.
    """
    members = members.join(label, members["class"] == label["node"], "left").select("bucket", "class", "n", "c", "bits", "earlier", F.coalesce("component", "class").alias("component"))
    least = members.groupBy("bucket").agg(F.min("n").alias("least"))
    members = members.join(least, "bucket").where(_possible(percent, F.col("n"), F.col("c"), F.col("least"), F.col("c"))).drop("least")
    parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    sizes = parts.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return members.join(sizes.select("bucket", "size", F.col("top.component").alias("top"), (F.col("size") - F.col("top.k")).alias("outside")), "bucket")


def _tests(live: DataFrame, percent: int, budget: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify in this turn, and the members that still have untested partners.

    A leader is tested against all members of other components and then leaves its bucket. All members outside the
    largest component lead if that makes at most ``budget`` pairs in the bucket, otherwise as many as do or the square root
    of ``budget``, whichever is more, chosen by a hash of the turn, and with them a few members of the largest component,
    which tie many others to it at once. But ``FEW`` lead in the first turn and its square in the second at most: the same few
    in all buckets that hold them tie most of a group of near copies, so that the many who lead later meet little that is
    still apart. So a turn's pairs grow with the members of a bucket and not with their square, and a bucket of k members
    is done after about k / sqrt(budget) turns.

    A pair whose two members are known to meet in an earlier bucket as well is left to that one (``earlier`` of both
    overlap), so near copies that share very many buckets are proposed once and not once a bucket.
    """
    dice = F.xxhash64("class", F.lit(turn))
    share = F.least(F.greatest(F.lit(float(budget)) / F.col("size"), F.lit(float(budget) ** 0.5)), F.lit(float(FEW) ** min(turn, 9))) / F.col("outside")
    minor = F.col("component") != F.col("top")
    drawn = minor & ((F.pmod(dice, F.lit(1_000_003)) / F.lit(1_000_003.0)) < share)
    who = F.struct("class", "component", "n", "c", "bits", "earlier")
    ranked = F.struct(dice.alias("r"), who.alias("who"))
    first = [F.min(F.when(minor, ranked)).alias("m")] + [
        F.min(F.when(~minor, F.struct(F.xxhash64("class", F.lit(turn * 1000 + i)).alias("r"), who.alias("who")))).alias(f"t{i}") for i in range(3)]
    heads = live.groupBy("bucket").agg(F.collect_list(F.when(drawn, who)).alias("drawn"), *first)
    heads = heads.select("bucket", F.array_distinct(F.filter(F.concat("drawn", F.array("m.who", *[F.col(f"t{i}.who") for i in range(3)])), lambda h: h.isNotNull())).alias("heads"))
    both = live.join(heads, "bucket")
    fits = F.filter("heads", lambda h: (h["component"] != F.col("component")) & _possible(percent, F.col("n"), F.col("c"), h["n"], h["c"]) & _alike(percent, F.col("n"), F.col("bits"), h["n"], h["bits"]) & ~F.arrays_overlap(h["earlier"], "earlier"))
    pairs = both.select("class", F.explode(fits).alias("h")).select(F.least("class", "h.class").alias("a"), F.greatest("class", "h.class").alias("b")).distinct()
    return pairs, both.where(~F.exists("heads", lambda h: h["class"] == F.col("class"))).select("bucket", "class", "n", "c", "bits", "earlier")


def _first_tests(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every member against one leader of its bucket, the same in all buckets that hold it."""
    ranked = F.struct(F.xxhash64("class").alias("r"), "class", "n", "c", "bits")
    heads = members.groupBy("bucket").agg(F.min(ranked).alias("h"), F.count(F.lit(1)).alias("size"))
    both = members.join(heads, "bucket").where(F.col("class") != F.col("h.class"))
    pairs = both.where(_possible(percent, F.col("n"), F.col("c"), F.col("h.n"), F.col("h.c")) & _alike(percent, F.col("n"), F.col("bits"), F.col("h.n"), F.col("h.bits")))
    pairs = pairs.select(F.least("class", "h.class").alias("a"), F.greatest("class", "h.class").alias("b")).distinct()
    return pairs, both.select("bucket", "class", "n", "c", "bits", "earlier")


def _slots(batches):
    """How often the items of a chunk fall into each slot."""
    for batch in batches:
        items = batch.column("items").flatten().to_numpy().view(U)
        slot, times = np.unique((mix64(items) & U(SLOTS - 1)).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(times.astype(np.int64))], ["slot", "times"])


def _prefixes(often: np.ndarray, percent: int, small: int):
    """The rarest items of every set as buckets, with what both kinds of buckets need to know.

    ``earlier`` of a bucket holds, for several permutations, the least of the items that stand before it in the set's
    order: where two members agree in one, they share that item and meet in its bucket too.
    """
    def run(batches):
        for batch in batches:
            out = []
            for name, column in zip(batch.column("class").to_pylist(), batch.column("items")):
                items = column.values.to_numpy().view(U)
                times = often[(mix64(items) & U(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((items, times))
                length = len(items) - -(-len(items) * percent // 100) + 1
                first, n = order[:length], np.full(length, len(items))
                c = np.where(times[first] > small, np.count_nonzero(times > small), np.count_nonzero(times > 1))
                before = [np.minimum.accumulate(mix64(items[first] ^ salt)) for salt in SALTS]
                keep = times[first] > 1
                place = np.arange(length)[keep]
                bits = parity_bits(items, np.array([0, len(items)]))
                earlier = np.array([np.append(U(0), x[:-1])[keep] for x in before]).T.reshape(-1)
                counts = np.where(place > 0, len(SALTS), 0)
                out.append((np.full(len(place), name), items[first][keep], n[keep], c[keep], np.tile(bits[0], len(place)), earlier.reshape(-1, len(SALTS))[place > 0].reshape(-1), counts))
            names, bucket, n, c, bits, earlier, counts = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)), pa.array(names.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64)), list_column(pa.array(bits), np.full(len(bucket), PARITY // 64)),
                 list_column(pa.array(earlier.view(np.int64)), counts)],
                ["bucket", "class", "n", "c", "bits", "earlier"])

    return run


def _prefix_members(heavy: DataFrame, sets: DataFrame, percent: int, small: int) -> DataFrame:
    """Other buckets for the members of crowded ones: two sets at the threshold share one of their rarest items.

    A set of n items needs n - ceil(percent/100 * n) + 1 of them, counted from the rarest. What makes a bucket crowded is
    a common passage, and its items are not among the rarest. No pair at the threshold is lost.

    The order of items is that of counts in ``SLOTS`` slots, a table of fixed size that goes to all tasks: any order that
    all sets share will do, and a slot's count is never less than an item's. Items of slots with at most ``small``
    are the first of every set's list. Whoever shares one meets in its bucket, so a bucket of a more frequent item need only find pairs
    that share frequent items alone: ``c`` counts those.
    """
    chosen = sets.join(heavy.select("class").distinct(), "class", "left_semi")
    counted = chosen.mapInArrow(_slots, "slot int, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    often = np.zeros(SLOTS, dtype=np.int32)
    often[counted.column("slot").to_numpy()] = np.minimum(counted.column("times").to_numpy(), np.iinfo(np.int32).max)
    return chosen.mapInArrow(_prefixes(often, percent, small), "bucket long, class long, n long, c long, bits array<long>, earlier array<long>")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 20, rows: int = 4, budget: int = 50_000, small: int = 64,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z), split at white space, and compared as sets of distinct ``width``-word shingles; two
    documents are linked when 100 * intersection >= percent * union, and a component keeps its smallest id.

    Documents with equal sets are one class from the start and never meet as pairs. Band buckets propose pairs of
    classes (a link at the threshold is missed by all ``bands`` bands with probability (1 - (percent/100)^rows)^bands,
    3e-5 for the defaults), full sets confirm them. The first turn ties every member to one member of its bucket. Later
    turns test only what is still in different components: buckets of at most ``small`` members as they are, while the
    members of larger ones are bucketed anew by their rarest shingles, which loses no pair, and worked off with about
    ``budget`` pairs a bucket and turn, or the square root of ``budget`` pairs a member. No crowded bucket ever emits all its pairs.

    Null or empty texts have no shingles and are linked with nothing. Rows with a null id are kept, with a null
    component. Rows that repeat an id but not its text share its name.
    """
    base = text_rows(docs, id_col, text_col)
    key_type = f"doc_id long, {TEXT_KEY} long"
    sketch = stage(base.mapInArrow(_sketches(width, bands, rows), f"{key_type}, n long, d1 long, d2 long, bands array<long>, bits array<long>"), "sketches")
    filled = sketch.where("n > 0")
    first = F.min(F.struct("doc_id", TEXT_KEY)).alias("first")
    classes = stage(filled.groupBy("n", "d1", "d2").agg(first).select("n", "d1", "d2", "first.*"), "set-classes")
    first_of = filled.join(classes.select(*KEYS), KEYS, "left_semi").select(F.col("doc_id").alias("class"), "n", F.transform("bands", lambda h, i: F.xxhash64(i, h)).alias("bands"), "bits").distinct()
    heads = stage(first_of.withColumn("set", F.xxhash64("n", "bands")), "band-heads")  # an id may name several sets
    buckets = heads.select("class", "set", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    met = buckets.join(shared, "bucket", "left_semi").join(heads, ["class", "set"])
    members = stage(met.select("bucket", "class", "n", F.col("n").alias("c"), "bits", F.slice("bands", F.lit(1), F.col("band")).alias("earlier")), "band-members")
    discard(heads)
    involved = classes.join(members.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi").select(*KEYS)
    sets = stage(base.join(same_at_every_size(involved), KEYS).select(F.col("doc_id").alias("class"), "text").mapInArrow(_sets(width), "class long, items array<long>"), "shingle-sets")
    wide, label, turn = ["bucket", "class", "n", "c", "bits", "earlier"], None, 0
    while True:
        if turn == 0:
            pairs, rest = _first_tests(members, percent)
            read = [members]
        else:
            live = stage(_live(members, label, percent), "live-members", give_back=False)
            discard(members)
            if turn == 1:  # band buckets become small ones and buckets of the rarest shingles, which are tested together
                anew = stage(_prefix_members(live.where(F.col("size") > small), sets, percent, small), "prefix-members", give_back=False)
                held = live.where(F.col("size") <= small).unionByName(_live(anew, label, percent))
                before, live = [live, anew], stage(held, "live-members", give_back=False)
                discard(*before)
            if is_empty(live):
                discard(live)
                break
            pairs, rest = _tests(live, percent, budget, turn)
            read = [live]
        loaded = pairs.join(sets.select(F.col("class").alias("a"), F.col("items").alias("left")), "a").join(
            sets.select(F.col("class").alias("b"), F.col("items").alias("right")), "b").select("a", "b", "left", "right")
        linked = stage(loaded.mapInArrow(_verified(percent), "a long, b long"), "verified-links", give_back=turn < 2)
        if label is None:
            label = stars(linked)
        elif not is_empty(linked):
            ended = label
            label = stars(linked.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            discard(ended)
        members = stage(rest.select(*wide), "untested-members", give_back=turn < 2)
        discard(linked, *read)
        turn += 1
    discard(sets)
    named = classes.join(label, classes["doc_id"] == label["node"], "left").select("n", "d1", "d2", F.coalesce("component", "doc_id").alias("component_id"))
    result = filled.join(named, ["n", "d1", "d2"]).select("doc_id", TEXT_KEY, F.col("n").alias("n_shingles"), "component_id")
    empty = sketch.where("n = 0").select("doc_id", TEXT_KEY, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nameless = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), row_key(text_col).alias(TEXT_KEY), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return result.unionByName(empty).unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        "doc_id", "n_shingles", "component_id", "kept", TEXT_KEY)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller id; columns as they were, null ids stay."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col(TEXT_KEY).alias("_key")).distinct()
    gone = same_at_every_size(stage(gone, "near-duplicates"))
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone"]) & (row_key(text_col) == gone["_key"]), "left_anti")
