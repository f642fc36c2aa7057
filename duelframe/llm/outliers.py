"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source, all in SQL functions.

Statistics of a text become a vector; every group of documents gets the centre and scatter of that three quarters of its
vectors whose covariance has the least determinant (concentration steps from three deterministic starts, then one
reweighting step); a document whose Mahalanobis distance is too large is rejected.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelframe.llm.staging import TEXT_KEY, discard, row_key, same_at_every_size, stage

WORDS = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: The statistics of a vector with the least standard deviation that counts as one.
VECTOR = {"length": 0.08, "symbols": 0.06, "lines": 0.12, "repeats": 0.12, "capitals": 0.08}
P = len(VECTOR)
PAIRS = list(combinations_with_replacement(range(P), 2))
BINS_PER_DOUBLING = 64
STARTS = 3


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


WINDOW = 5


def _hashes(words: str) -> Column:
    """64-bit hashes of the windows of WINDOW words."""
    last = F.size(words) - WINDOW
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)]))
    return F.when(last > 0, each).otherwise(F.array().cast("array<long>"))


def _covered(hashes: str) -> Column:
    """Number of words in windows whose hash occurs twice or more."""
    order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    again = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(let(order, again), lambda x: x["at"]))
    begin = F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).alias("n"))
    step = lambda acc, at: F.struct(at.alias("before"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["before"])).alias("n"))
    return F.aggregate(starts, begin, step, lambda acc: acc["n"])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, text key, lang, source and the counts of its whole text. A null text counts as empty.

    Words and window hashes are columns of their own that several expressions read, so each is computed once and the
    array functions on them run as generated code; only texts with a repeated window are looked at more closely.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias(TEXT_KEY), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keep = ["doc_id", TEXT_KEY, "lang", "source"]
    split = rows.select(
        *keep, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"))
    counted = split.select(
        *keep, F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), _hashes("words").alias("hashes"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_symbols", "n_capitals")
    repeats = F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(_covered("hashes"))
    return counted.select(*keep, "n_words", "word_chars", repeats.cast("long").alias("n_repeat_words"), "n_lines", "n_dup_lines", "n_symbols", "n_capitals")


def vector() -> list[Column]:
    """The transformed statistics in the order of VECTOR: log mean word length and arcsine roots of shares.

    A fixed number of words or lines of no evidence is added below each share, so that short texts vary no more than long ones.
    """
    c = F.col
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), part / whole)))
    return [
        F.log((c("word_chars") + 120) / (c("n_words") + 20)), share(c("n_symbols"), c("word_chars") + 120), share(c("n_dup_lines"), c("n_lines") + 4),
        share(c("n_repeat_words"), c("n_words") + 20), share(c("n_capitals"), c("word_chars") + 120),
    ]


def chi2_below(x: float, k: float) -> float:
    """P(chi squared with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_point(share: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, k) < share else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the innermost ``share`` of a normal sample is multiplied with to be unbiased."""
    return share / chi2_below(chi2_point(share, P), P + 2)


def inverse(cov: Column) -> Column:
    """inv (rows) and logdet of a positive definite matrix, by Gauss-Jordan elimination."""
    unit = F.transform(cov, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))))

    def eliminate(acc: Column, k: Column) -> Column:
        m = acc["m"]
        top = F.get(m, k)
        pivot = F.get(top, k)
        rows = F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda v: v / pivot)).otherwise(
            F.transform(row, lambda v, j: v - F.get(row, k) * F.get(top, j) / pivot)))
        return F.struct(rows.alias("m"), (acc["logdet"] + F.log(pivot)).alias("logdet"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(P - 1)), F.struct(unit.alias("m"), F.lit(0.0).alias("logdet")), eliminate,
        lambda acc: F.struct(F.transform(acc["m"], lambda row: F.slice(row, P + 1, P)).alias("inv"), acc["logdet"].alias("logdet")))


def _medians(rows: DataFrame, value: list[Column], bins: int = 1024) -> DataFrame:
    """group, m0..: the median of each value in steps of 1 / ``bins``, from counts by step (no group in one task)."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(v * bins).alias("bin")) for j, v in enumerate(value)]))
    counts = rows.select("group", each.alias("e")).groupBy("group", "e.j", "e.bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("group", "j")
    upto = F.sum("n").over(by.orderBy("bin"))
    half = counts.select("group", "j", "bin", upto.alias("upto"), F.sum("n").over(by).alias("all")).where(F.col("upto") * 2 >= F.col("all"))
    middle = half.groupBy("group", "j").agg(((F.min("bin") + 0.5) / bins).alias("m"))
    return middle.groupBy("group").agg(*[F.max(F.when(F.col("j") == j, F.col("m"))).alias(f"m{j}") for j in range(len(value))])


def _with_groups(rows: DataFrame, table: DataFrame, limit: int = 20_000) -> DataFrame:
    """Rows with their group's line; the table is sent to all tasks only while it is proven to have at most ``limit`` lines."""
    small = table.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(table) if small else table, "group")


def _sums(y: list[Column], weight: Column | None = None) -> list[Column]:
    w = (lambda v: v * weight) if weight is not None else (lambda v: v)
    ones = F.lit(1.0) if weight is None else weight
    return [F.sum(ones).alias("n"), *[F.sum(w(v)).alias(f"s{i}") for i, v in enumerate(y)], *[F.sum(w(y[i] * y[j])).alias(f"q{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre c0.., inverse scatter a00.. and logdet from sums; every variance gets its least value added."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    floor = [x * x for x in VECTOR.values()]

    def cell(i, j):
        i, j = min(i, j), max(i, j)
        plain = (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * factor
        return plain + floor[i] if i == j else plain

    cov = F.array(*[F.array(*[cell(i, j) for j in range(P)]) for i in range(P)])
    found = sums.select(*keys, *[m.alias(f"c{i}") for i, m in enumerate(mean)], cov.alias("cov")).select(*keys, *[f"c{i}" for i in range(P)], inverse(F.col("cov")).alias("x"))
    return found.select(*keys, *[f"c{i}" for i in range(P)], *[F.col("x.inv")[i][j].alias(f"a{i}{j}") for i, j in PAIRS], F.col("x.logdet").alias("logdet"))


def _distance() -> Column:
    d = [F.col(f"y{i}") - F.col(f"c{i}") for i in range(P)]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [F.col(f"a{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in PAIRS]))


def _concentrate(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """One step for all groups and starts: the new estimate from the ``share`` of rows nearest to the present one.

    Sums are kept by small steps of the distance, so the nearest rows of a group of any size are found by adding up
    counts. The step in which the share is reached enters with the part that fills it.
    """
    met = _with_groups(rows, now).withColumn("d", _distance())
    steps = met.groupBy("start", "group", F.floor(F.log2(F.col("d") + 1) * BINS_PER_DOUBLING).alias("bin")).agg(*_sums([F.col(f"y{i}") for i in range(P)]))
    by = Window.partitionBy("start", "group")
    upto = F.sum("n").over(by.orderBy("bin"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.sum("n").over(by) * share - (upto - F.col("n"))) / F.col("n")))
    names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
    inner = steps.withColumn("part", part).where("part > 0").groupBy("start", "group").agg(*[F.sum(F.col(x) * F.col("part")).alias(x) for x in names])
    return _estimate(inner, ["start", "group"], 1.0)


def _starts(rows: DataFrame) -> DataFrame:
    """Three deterministic first estimates at the medians: plain scales, scatter of tanh values, scatter of directions."""
    u = [F.col(f"y{i}") / F.col(f"k{i}") for i in range(P)]
    norm = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in u]))
    kinds = [[F.tanh(x) for x in u], [F.when(norm > 0, x / norm * math.sqrt(P)).otherwise(F.lit(0.0)) for x in u]]
    sums = [F.avg(v[i] * v[j] * F.col(f"k{i}") * F.col(f"k{j}")).alias(f"t{n}_{i}{j}") for n, v in enumerate(kinds) for i, j in PAIRS]
    found = rows.groupBy("group").agg(*sums, *[F.max(f"k{i}").alias(f"k{i}") for i in range(P)])
    zero = F.lit(0.0)
    lines = []
    for n in range(STARTS):
        cells = {(i, j): (F.col(f"t{n - 1}_{i}{j}") if n else F.col(f"k{i}") * F.col(f"k{i}") if i == j else zero) for i, j in PAIRS}
        lines.append(F.struct(F.lit(n).alias("start"), *[cells[ij].alias(f"q{ij[0]}{ij[1]}") for ij in PAIRS]))
    each = found.select("group", F.explode(F.array(*lines)).alias("e")).select("group", "e.*", F.lit(1.0).alias("n"), *[zero.alias(f"s{i}") for i in range(P)])
    return _estimate(each, ["start", "group"], 1.0)


def least_determinants(rows: DataFrame, share: float = 0.75, steps: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """group, c0.., a00..: the reweighted MCD centre and inverse scatter. ``rows`` has group, y0.. (about the medians) and k0.. (scales).

    Concentration steps go on until no group's log determinant falls by more than ``tolerance`` (they end by
    themselves after some ten; ``steps`` bounds the jobs). The start with the least determinant wins. Then the rows within the
    97.5 % ellipsoid give the final estimate.
    """
    now = stage(_starts(rows), "mcd-estimates")
    for _ in range(steps):
        after = stage(_concentrate(rows, now, share), "mcd-estimates")
        was = now.select("start", "group", F.col("logdet").alias("was"))
        change = after.join(was, ["start", "group"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        discard(now)
        now = after
        if change is None or change < tolerance:
            break
    columns = [c for c in now.columns if c not in ("group", "start", "logdet")]
    best = now.groupBy("group").agg(F.min(F.struct("logdet", "start", *columns)).alias("b")).select("group", *[F.col(f"b.{c}").alias(c) for c in columns])
    inside = _with_groups(rows, stage(best, "mcd-raw")).where(_distance() / consistency(share) <= chi2_point(0.975, P))
    final = stage(_estimate(inside.groupBy("group").agg(*_sums([F.col(f"y{i}") for i in range(P)])), ["group"], consistency(0.975)), "mcd-final")
    discard(now)
    return final.drop("logdet")


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 10, most_repeats: int = 20,
    least_rows: int = 100, share: float = 0.75, reject: float = 0.001,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, text key.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeats`` percent of the words in repeated 5-word
    windows. Other documents are kept unless their squared distance exceeds the point that a chi squared value passes with
    probability ``reject``. Estimates use all documents with a word. A language and source with fewer than ``least_rows`` of
    them is estimated with the language's other small sources, and where these are too few as well, with all such rest.

    Null and empty texts have no words and fail the base rule; a null language or source counts as an empty one; rows without
    an id and repeated rows get a row each; an empty table gives no rows; other columns are not read.
    """
    stats = stage(text_statistics(docs, id_col, text_col, lang_col, source_col), "text-statistics")
    worded = stats.where("n_words > 0")
    many = worded.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("many"))
    langs = many.where(F.col("many") < least_rows).groupBy("lang").agg(F.sum("many").alias("small"))
    group = F.when(F.col("many") >= least_rows, F.concat_ws("\u0001", F.lit("source"), "lang", "source")).when(
        F.col("small") >= least_rows, F.concat_ws("\u0001", F.lit("lang"), "lang")).otherwise(F.lit("rest"))
    names = stage(many.join(langs, "lang", "left").select("lang", "source", group.alias("group")), "mcd-groups")
    few = names.limit(20_001).count() <= 20_000
    grouped = worded.join(F.broadcast(names) if few else names, ["lang", "source"])
    base = stage(grouped.select("group", *[v.alias(f"x{i}") for i, v in enumerate(vector())]), "mcd-values")
    xs = [F.col(f"x{i}") for i in range(P)]
    centre = stage(_medians(base, xs), "mcd-medians")
    centred = _with_groups(base, centre).select("group", *[(x - F.col(f"m{i}")).alias(f"y{i}") for i, x in enumerate(xs)])
    spread = stage(_medians(centred, [F.abs(f"y{i}") for i in range(P)]).select(
        "group", *[F.greatest(F.col(f"m{i}") * 1.4826, F.lit(floor)).alias(f"k{i}") for i, floor in enumerate(VECTOR.values())]), "mcd-scales")
    rows = stage(_with_groups(centred, spread), "mcd-rows")
    final = least_determinants(rows, share)
    discard(base, rows, spread)
    fit = stage(names.join(centre, "group").join(final, "group"), "mcd-fits")
    discard(names, centre)
    back = stats.join(F.broadcast(fit) if few else fit, ["lang", "source"], "left")
    placed = back.select(*stats.columns, *[(v - F.col(f"m{i}")).alias(f"y{i}") for i, v in enumerate(vector())], *[f"c{i}" for i in range(P)], *[f"a{i}{j}" for i, j in PAIRS])
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeats)
    near = F.coalesce(F.col("distance") <= chi2_point(1 - reject, P), F.lit(True))
    return placed.withColumn("distance", F.when(F.col("n_words") > 0, _distance())).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance", TEXT_KEY)


def drop_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that a rule or the distance rejects; columns as they were, rows without an id stay."""
    gone = quality_verdicts(docs, id_col, text_col, **options).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"), F.col(TEXT_KEY).alias("_key")).distinct()
    gone = same_at_every_size(stage(gone, "quality-outliers"))
    return docs.join(gone, (docs[id_col].cast("long") == gone["_gone"]) & (row_key(text_col) == gone["_key"]), "left_anti")
