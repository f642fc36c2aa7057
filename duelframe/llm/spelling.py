"""Spelling variants: words that differ by one letter, found by pivotal bigrams with position limits.

Two words at edit distance 1 keep, under that edit, one of any two disjoint bigrams of either word. Every word picks two
disjoint pivots, as rare as possible, among its rarest bigrams; the word whose rare bigrams end earlier in the global order
finds a pivot among the other word's rare bigrams. With a single edit the part of the word on one side of that pivot is
the same letter by letter, so the pivot's place is limited to one place from the left or one from the right, and the part
itself belongs to the key under which pivots and prefixes meet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.llm.staging import discard, is_empty, stage

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 2


def pivots(places: list[int], weights: list[int], many: int = 2, width: int = GRAM) -> list[int]:
    """The indices of ``many`` grams of ``width`` letters that do not overlap and have the least total weight.

    ``places`` ascend. Dynamic programming over the grams from left to right: the best choice of j grams that ends at or
    before gram i either skips gram i or takes it after the best choice of j - 1 grams that end before it. Ties keep the
    choice found first. None when there is no such choice.
    """
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * many]
    before = 0  # grams that end before gram i starts
    for i, place in enumerate(places):
        while places[before] + width <= place:
            before += 1
        row = list(best[-1])
        for j in range(1, many + 1):
            base = best[before][j - 1]
            if base and (row[j] is None or base[0] + weights[i] < row[j][0]):
                row[j] = (base[0] + weights[i], (*base[1], i))
        best.append(row)
    return list(best[-1][many][1]) if best[-1][many] else None


def _grams(order: dict[str, tuple[int, int]]):
    """Prefix and pivot entries of every word. ``order`` gives the rank and the count of each bigram."""
    def run(frames):
        for frame in frames:
            out = []
            for word, n in zip(frame["word"], frame["n"]):
                ranks = [order[word[i : i + GRAM]] for i in range(len(word) - 1)]
                last = sorted(r for r, _ in ranks)[GRAM]  # two edits could not spoil all three; equal grams stay in
                prefix = [i for i, (r, _) in enumerate(ranks) if r <= last]
                chosen = pivots(prefix, [ranks[i][1] for i in prefix])
                out += [(word, n, last, i, k in chosen) for k, i in enumerate(prefix)]
            yield pd.DataFrame(out, columns=["word", "n", "last", "place", "pivot"])

    return run


def lower_ascii(word: Column) -> Column:
    """A-Z to a-z and nothing else; words of ASCII letters take the quick way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, CAPITALS, SMALL))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: lower-cased runs of letters of at least ``least_length`` code points with ``least_count`` occurrences.

    With ``slips`` the text is misspelled on purpose first, the same way at every run: a run whose crc32 (of
    ``id:run``) is divisible by ``slips`` loses one code point. Rows without an id count with their words as they are.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if slips:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.col("h") % slips == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _key(entry: DataFrame) -> DataFrame:
    """Adds the bucket of an entry: the pivot word's length, and the first a and last b letters that both words share."""
    return entry.withColumn("bucket", F.xxhash64(
        "length", "a", "b", F.substr("word", F.lit(1), F.col("a")), F.substr("word", F.char_length("word") - F.col("b") + 1, F.col("b"))))


def _sides(grams: DataFrame, length: Column) -> DataFrame:
    """Two entries for a gram: the edit comes after it, then the letters up to its end are shared; or before, then those from its start."""
    size = F.char_length("word")
    sides = F.array(F.struct((F.col("place") + GRAM).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (size - F.col("place")).alias("b")))
    rows = grams.select("word", "n", "last", length.alias("length"), F.explode(sides).alias("s")).select("word", "n", "last", "length", "s.a", "s.b")
    return _key(rows.where(F.col("a") + F.col("b") <= F.least("length", F.char_length("word"))))


def _halves(entries: DataFrame) -> DataFrame:
    """The entries again with the letters in which the edit can lie halved: it is in their first half or in their second."""
    middle = F.floor((F.col("length") - F.col("a") - F.col("b")) / 2).cast("int")
    cuts = F.array(F.struct("a", (F.col("length") - F.col("a") - middle).alias("b")), F.struct((F.col("a") + middle).alias("a"), "b"))
    rows = entries.select("word", "n", "last", "length", F.explode(cuts).alias("s")).select("word", "n", "last", "length", "s.a", "s.b")
    return _key(rows.where(F.col("a") + F.col("b") <= F.char_length("word")))


def near_pairs(words: DataFrame, budget: int = 10_000) -> DataFrame:
    """left, left_n, right, right_n: each pair of words (word, n; at least four letters) at edit distance 1, once, left before right.

    A bucket in which pivots and prefixes could make more than ``budget`` candidates is not joined; its entries are spread
    over buckets that share half of the remaining letters as well, again and again until none is left or one letter
    remains (then the bucket holds near words only, at most some 90 squared). No pair is lost at any step.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(GRAM)))).alias("gram"))
    # the letters a-z and U+00C0 to U+00FF: at most 90 * 90 bigrams, so this table is small whatever the corpus
    counted = sorted((r["times"], r["gram"]) for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).collect())
    order = {gram: (rank, times) for rank, (times, gram) in enumerate(counted)}
    chosen = stage(words.mapInPandas(_grams(order), "word string, n long, last int, place int, pivot boolean"), "spelling-grams")
    size = F.char_length("word")
    ours = stage(_sides(chosen.where("pivot"), size), "spelling-pivots")
    theirs = stage(_sides(chosen.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))), size + F.col("step")), "spelling-prefixes")
    discard(chosen)
    found = []
    while True:
        load = ours.groupBy("bucket").agg(F.count(F.lit(1)).alias("p"), F.max(F.col("length") - F.col("a") - F.col("b")).alias("gap")).join(
            theirs.groupBy("bucket").agg(F.count(F.lit(1)).alias("q")), "bucket")
        crowded = stage(load.where((F.col("p") * F.col("q") > budget) & (F.col("gap") > 1)).select("bucket"), "spelling-crowded")
        done = is_empty(crowded)
        light = ours if done else ours.join(crowded, "bucket", "left_anti")
        s, r = light.alias("s"), theirs.alias("r")
        met = s.join(r, "bucket").where((F.col("s.last") <= F.col("r.last")) & (F.col("s.word") != F.col("r.word")))
        near = met.where(F.levenshtein(F.col("s.word"), F.col("r.word"), 1) == 1).select(
            F.struct("s.word", "s.n").alias("x"), F.struct("r.word", "r.n").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        found.append(stage(near.select(F.col("x.word").alias("left"), F.col("x.n").alias("left_n"), F.col("y.word").alias("right"), F.col("y.n").alias("right_n")).distinct(), "spelling-pairs"))
        if done:
            break
        before = ours, theirs
        ours, theirs = (stage(_halves(t.join(crowded, "bucket", "left_semi")), "spelling-halves") for t in before)
        discard(*before, crowded)
    discard(ours, theirs, crowded)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain word -> form, by doubling the step. Counts at least double along a chain, so it ends."""
    jump = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(jump.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = not is_empty(after.where("moved"))
        discard(jump)
        jump = after
        if not moved:
            return jump.drop("moved")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None, least_length: int = 5, least_count: int = 3, times: int = 2, budget: int = 10_000,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the lower-cased (A-Z) runs of letters ``word_counts`` keeps, from whole texts. A word's form is its most
    frequent near word (one code point inserted, deleted or replaced; ties: smallest in code-point order) if that is at
    least ``times`` as frequent, else null; its root is where following forms ends, itself without a form.

    Null and empty texts have no words, an empty table gives no rows, repeated rows count as often as they occur, and
    other columns are not read. ``least_length`` must be at least 4, so that three bigrams exist.
    """
    if least_length < 4 or times < 2:
        raise ValueError("words need at least four letters, and forms at least twice the count of their variants")
    words = stage(word_counts(docs, id_col, text_col, slips, least_length, least_count), "spelling-words")
    pairs = stage(near_pairs(words, budget), "spelling-near")
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("left").alias("word"), F.col("right").alias("other"), F.col("right_n").alias("other_n")),
        F.struct(F.col("right").alias("word"), F.col("left").alias("other"), F.col("left_n").alias("other_n")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.less") >= F.col("n") * times
    known = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-forms")
    discard(words, pairs)
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
