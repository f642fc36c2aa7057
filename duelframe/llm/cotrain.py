"""A quality classifier by co-training: one model reads the text, the other the document's metadata.

Both are fitted by Spark on labelled rows. In each round a model labels the unlabelled documents it is sure of, and the
other learns from them. At the end each view is calibrated on labelled rows that no model has seen, and a third fit on
those rows weighs the calibrated views.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.llm.arrays import chunks, span_hashes, text_bytes, words
from duelframe.llm.staging import stage

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "newline": [10],
    "stop": b".", "comma": b",", "bang": b"!", "percent": b"%", "star": b"*", "dollar": b"$", "and": b"&", "hash": b"#", "bar": b"|",
    "bracket": b"()[]{}<>", "slash": b"/\\", "quote": b"\"'", "other": b"+-=_~^@;:?`",
}
CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i
TEXT_FEATURES = len(_CLASSES) + 8


def text_features(batch: pa.RecordBatch) -> np.ndarray:
    """Shares of byte classes, lengths, and how much of the text repeats itself; empty texts give zeros."""
    data, offsets = text_bytes(batch)
    rows, size = batch.num_rows, len(_CLASSES)
    n = np.diff(offsets)
    of = np.repeat(np.arange(rows), n)
    counts = np.bincount(of * (size + 1) + CLASS_OF[data], minlength=rows * (size + 1)).reshape(rows, size + 1)[:, :size]
    starts, ends, row = words(data, offsets)
    h = span_hashes(data, starts, ends)
    n_words = np.bincount(row, minlength=rows)
    each = np.maximum(n_words, 1)
    same = np.bincount(row[1:], weights=(h[1:] == h[:-1]) & (row[1:] == row[:-1]), minlength=rows) if len(h) else np.zeros(rows)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1]))[: len(hs)]
    different = np.bincount(rs[new], minlength=rows)
    last = CLASS_OF[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    symbol = np.bincount(row, weights=(last >= list(_CLASSES).index("bang")), minlength=rows)
    lines = counts[:, list(_CLASSES).index("newline")] + 1
    x = np.column_stack([
        counts / np.maximum(n, 1)[:, None], np.log1p(n), np.log1p(n_words), np.log1p(lines), n / each / 10.0, same / each, different / each, symbol / each,
        np.log1p(n_words / lines)])
    x[n == 0] = 0.0
    return x


def _text_view(batches):
    for batch in chunks(batches):
        x = text_features(batch)
        flat = pa.array(x.ravel())
        edges = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        keep = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(edges, flat)], [*[c for c in batch.schema.names if c != "text"], "text_x"])


def metadata_view(categories: list[str], numbers: list[str], slots: int) -> Column:
    """Categories hashed to ``slots`` places each, and logarithms of numbers; null is a category of its own, a null number 0."""
    parts = []
    for c in categories:
        at = F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(slots))
        parts.append(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i, at=at: (i == at).cast("double")))
    for c in numbers:
        parts.append(F.array(F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))))
    return F.concat(*parts)


def _fit(rows: DataFrame, features: str, ridge: float):
    return LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", regParam=ridge, maxIter=50, probabilityCol="p", rawPredictionCol="raw", predictionCol="at").fit(rows)


def _logit(model, rows: DataFrame, features: str, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("raw")[1]).drop("raw", "p", "at")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    categories: list[str] = ("lang", "source"), numbers: list[str] = ("n_chars",), slots: int = 32,
    rounds: int = 2, sure: float = 0.97, pseudo_weight: float = 0.25, ridge: float = 1e-4, calibration_fold: int = 5,
) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (chance of label 1).

    One labelled row in ``calibration_fold``, by a hash of the id, is kept for calibration. Pseudo-labels come from all
    unlabelled documents on which a view gives a chance of at least ``sure``, and weigh ``pseudo_weight``. If the labels
    have fewer than two classes, every score is the share of label 1 (0.5 without labels).

    Null and empty texts have zero text features; null metadata is a category of its own; null ids and repeated rows are
    scored like all others. Labels other than 0 and 1 are ignored; of several labels of one id the largest counts.
    """
    meta = metadata_view(list(categories), list(numbers), slots)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), meta.alias("meta_x"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    views = stage(rows.mapInArrow(_text_view, "doc_id long, meta_x array<double>, text_x array<double>").join(known, "doc_id", "left"), "quality-views")
    vectors = views.select("doc_id", "label", array_to_vector("text_x").alias("text_v"), array_to_vector("meta_x").alias("meta_v"))
    totals = {r["label"]: r["count"] for r in vectors.where("label IS NOT NULL").groupBy("label").count().collect()}
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(calibration_fold)) == 0
    learn = vectors.where(F.col("label").isNotNull() & ~aside).withColumn("weight", F.lit(1.0))
    check = vectors.where(F.col("label").isNotNull() & aside).withColumn("weight", F.lit(1.0))
    if len(totals) < 2 or learn.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        share = F.lit(totals.get(1.0, 0) / sum(totals.values()) if totals else 0.5)
        return vectors.select("doc_id", share.alias("text_score"), share.alias("meta_score"), share.alias("score"))
    free = vectors.where("label IS NULL").drop("label")
    views_of = {"text": "text_v", "meta": "meta_v"}
    models = {v: _fit(learn, c, ridge) for v, c in views_of.items()}
    for _ in range(rounds):
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
            guessed = _logit(models[teacher], free, views_of[teacher], "logit").withColumn("q", p).where((F.col("q") >= sure) | (F.col("q") <= 1 - sure))
            taught = guessed.select("doc_id", (F.col("q") >= 0.5).cast("double").alias("label"), "text_v", "meta_v", F.lit(pseudo_weight).alias("weight"))
            models[pupil] = _fit(learn.unionByName(taught), views_of[pupil], ridge)
    for v, c in views_of.items():
        check = _logit(models[v], check, c, f"{v}_l")
        vectors = _logit(models[v], vectors, c, f"{v}_l")
    platt = {}
    for v in views_of:
        fitted = _fit(check.withColumn("x", array_to_vector(F.array(f"{v}_l"))), "x", 1e-6)
        platt[v] = F.col(f"{v}_l") * float(fitted.coefficients[0]) + float(fitted.intercept)
    joined = array_to_vector(F.array(*platt.values()))
    last = _fit(check.withColumn("x", joined), "x", 1e-6)
    total = sum((c * float(w) for c, w in zip(platt.values(), last.coefficients)), F.lit(float(last.intercept)))
    chance = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return vectors.select("doc_id", chance(platt["text"]).alias("text_score"), chance(platt["meta"]).alias("meta_score"), chance(total).alias("score"))
