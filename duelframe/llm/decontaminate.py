"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The sum of a passage's largest impacts per block of items bounds all scores in the block; blocks below the threshold are
skipped for many passages at once, and WAND searches the others item by item.

Every passage of every training document is a query. A score is divided by the item's score against itself, so 1 means
that the passage has all of the item's terms, and one threshold serves items of any length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelframe.llm.arrays import U, chunks, lower_ascii, shingle_hashes, span_hashes, spans, text_bytes
from duelframe.llm.staging import TEXT_KEY, row_key, stage

K1, B = 1.2, 0.75
SLACK = 1e-4  # more than the rounding of sums of single-precision bounds
_ANSWER = re.compile(r"(?i)(?:^|\n)\s*(?:answer|a)\s*[:.)]\s*")
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(batch: pa.RecordBatch, column: str = "text"):
    """Term hashes of lower-cased words of letters and digits, and the row of each."""
    data, offsets = text_bytes(batch, column)
    data = lower_ascii(data)
    starts, ends, row = spans(_TOKEN[data], offsets)
    return span_hashes(data, starts, ends), row


def term_hashes(text: str) -> np.ndarray:
    return _terms(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"]))[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """Split an item at an answer mark, else before its last sentence, else before its last quarter of words."""
    mark = _ANSWER.search(text)
    if mark and mark.start() > 0 and mark.end() < len(text):
        return text[: mark.start()], text[mark.end() :]
    sentences = re.split(r"(?<=[.?!])\s+", text.strip())
    if len(sentences) > 1 and len(sentences[-1].split()) >= 3:
        return " ".join(sentences[:-1]), sentences[-1]
    w = text.split()
    cut = max(1, len(w) - max(1, len(w) // 4))
    return " ".join(w[:cut]), " ".join(w[cut:])


class ItemIndex:
    """Postings of the items' terms with impacts. Items stand in blocks, and every term has its largest impact per block."""

    BLOCKS = 64

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], total: int, mean_length: float, longest: int):
        self.ids = [i for i, _ in items]
        self.block, postings = max(1, -(-len(items) // self.BLOCKS)), {}
        self.longest = longest  # of all items, also those of other parts
        self.question: list[tuple[int, np.ndarray]] = []
        self.answer: list[tuple[int, np.ndarray]] = []
        for n, (_, text) in enumerate(items):
            h = term_hashes(text)
            terms, times = np.unique(h, return_counts=True)
            idf = np.array([math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in terms.tolist()])
            impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(h) / mean_length)) if len(h) else idf
            impact = impact / (impact.sum() or 1.0)
            for t, w in zip(terms.tolist(), impact.tolist()):
                postings.setdefault(t, []).append((n, w))
            q, a = question_and_answer(text)
            self.question.append(self.grams(term_hashes(q)))
            self.answer.append(self.grams(term_hashes(a)))
        self.terms = np.array(sorted(postings), dtype=U)
        self.docs = [[n for n, _ in postings[t]] for t in self.terms.tolist()]
        self.impacts = [[w for _, w in postings[t]] for t in self.terms.tolist()]
        self.most = np.zeros((len(self.terms), max(1, -(-len(items) // self.block))), dtype=np.float32)
        for t, (docs, impacts) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.most[t], np.array(docs) // self.block, np.array(impacts, dtype=np.float32))

    @staticmethod
    def grams(h: np.ndarray, width: int = 4) -> tuple[int, np.ndarray]:
        """Distinct hashes of ``width`` consecutive terms, of all terms where there are fewer; the width comes first."""
        n = min(width, len(h))
        return n, np.unique(shingle_hashes(h, n)) if n else np.zeros(0, dtype=U)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of hashes, -1 for terms that no item has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for a query of different terms reaches ``threshold``."""
        found = []
        for block in np.flatnonzero(self.most[terms].sum(axis=0) >= threshold - SLACK).tolist():
            found += self.search_block(terms, block, threshold - 1e-9)
        return found

    def search_block(self, terms: list[int], block: int, bar: float) -> list[tuple[int, float]]:
        """WAND within a block, the block's largest impacts being the terms' bounds.

        Cursors stand in the order of their items. The pivot is the first one up to which the bounds reach the bar: no item
        before its own can. If all cursors up to it stand on its item, the item is scored; otherwise they move up to it.
        """
        low, high, found = block * self.block, (block + 1) * self.block, []
        bound, cursors = self.most[:, block], []
        for t in terms:
            if bound[t] > 0:
                at = bisect_left(self.docs[t], low)
                cursors.append([self.docs[t][at], at, t, float(bound[t]) + 1e-7])
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= bar:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            behind = [c for c in cursors if c[0] < pivot]
            if behind:
                target = pivot
            else:
                behind = [c for c in cursors if c[0] == pivot]
                score = sum(self.impacts[t][at] for _, at, t, _ in behind)
                if score >= bar:
                    found.append((pivot, score))
                target = pivot + 1
            for c in behind:
                docs = self.docs[c[2]]
                c[1] = bisect_left(docs, target, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else high
            cursors = [c for c in cursors if c[0] < high]
        return found

    def overlaps(self, item: int, h: np.ndarray) -> tuple[float, float]:
        """Shares of the grams of the item's question and answer that a passage has; a part without words counts as found."""
        shares = []
        for n, grams in (self.question[item], self.answer[item]):
            shares.append(float(np.isin(grams, shingle_hashes(h, n)).mean()) if n else 1.0)
        return shares[0], shares[1]


def _passages(h: np.ndarray, row: np.ndarray, rows: int, stride: int):
    """First and end term and row of passages of two strides that start every stride."""
    edges = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(edges)
    count = np.maximum(1, -(-(n - stride) // stride)) * (n > 0)
    of = np.repeat(np.arange(rows), count)
    begin = edges[of] + (np.arange(len(of)) - (np.cumsum(count) - count)[of]) * stride
    return begin, np.minimum(begin + 2 * stride, edges[of + 1]), of


def _candidates(index: ItemIndex, number: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float):
    """(passage, different terms, blocks) of passages for which some block's bound reaches the threshold."""
    for a in range(0, len(begin), 512):
        b = min(len(begin), a + 512)
        size = end[a:b] - begin[a:b]
        of = np.repeat(np.arange(b - a), size)
        term = number[np.repeat(begin[a:b], size) + np.arange(len(of)) - (np.cumsum(size) - size)[of]]
        key = np.unique((of * (len(index.terms) + 1) + term)[term >= 0])
        of, term = key // (len(index.terms) + 1), key % (len(index.terms) + 1)
        if not len(key):
            continue
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        bounds = np.add.reduceat(index.most[term], first, axis=0)
        last = np.append(first[1:], len(of))
        for i in np.flatnonzero((bounds >= threshold - SLACK).any(axis=1)).tolist():
            yield a + int(of[first[i]]), term[first[i] : last[i]].tolist(), np.flatnonzero(bounds[i] >= threshold - SLACK).tolist()


def _search(index: ItemIndex, threshold: float, question: float, answer: float):
    def run(batches):
        for batch in chunks(batches):
            h, row = _terms(batch)
            number = index.numbers(h)
            begin, end, of = _passages(h, row, batch.num_rows, index.longest)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for p, terms, blocks in _candidates(index, number, begin, end, threshold):
                for block in blocks:
                    for item, score in index.search_block(terms, block, threshold - 1e-9):
                        q, a = index.overlaps(item, h[begin[p] : end[p]])
                        if q >= question and a >= answer:
                            key = (int(of[p]), item)
                            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
            keys = list(best)
            r = pa.array([k[0] for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(r), batch.column(TEXT_KEY).take(r), pa.array([index.ids[k[1]] for k in keys], pa.int64()),
                 *[pa.array([best[k][j] for k in keys], pa.float64()) for j in range(3)]],
                ["doc_id", TEXT_KEY, "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = 0.6, question: float = 0.6, answer: float = 0.6, index_bytes: int = 1 << 20,
) -> DataFrame:
    """One row per document and test item that one of its passages contains: doc_id, item_id, score and overlaps.

    Passages are twice the longest item and start every longest item's length, so an item that a document quotes lies
    whole in one of them. All items whose normalised BM25 score reaches ``threshold`` are retrieved; those that share
    at least ``question`` and ``answer`` of the 4-grams of the item's two parts are reported.

    The index is sent to the tasks in parts of about ``index_bytes`` of item text, one pass over the documents for each, so
    a benchmark of any size is searched whole; term statistics and the length of passages come from all items, so the
    result does not depend on the parts.

    Null texts, texts without words and items without words match nothing; null ids of documents are searched like
    others, null item ids too. Repeated rows give one row each; empty tables give none.
    """
    spark = docs.sparkSession
    chosen = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    bounds = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-(bounds["bytes"] or 0) // index_bytes))
    counted = chosen.mapInArrow(_item_terms, "h long, n long, rows long").groupBy("h").agg(F.sum("n").alias("words"), F.sum("rows").alias("items"))
    counted = stage(counted, "item-terms")
    words = counted.agg(F.sum("words")).first()[0] or 0
    if not words:
        return spark.createDataFrame([], f"doc_id long, {TEXT_KEY} long, item_id long, score double, question_overlap double, answer_overlap double")
    longest = chosen.mapInArrow(_item_lengths, "n long").agg(F.max("n")).first()[0]
    key = row_key(text_col).alias(TEXT_KEY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key)
    numbered = chosen.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    out = None
    for part in range(parts):
        mine = numbered.where(F.col("part") == part)
        listed = [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]
        terms = mine.mapInArrow(_item_terms, "h long, n long, rows long").select("h").distinct()
        frequency = {r["h"] % (1 << 64): r["items"] for r in counted.join(terms, "h", "left_semi").select("h", "items").collect()}
        index = ItemIndex(listed, frequency, bounds["n"], words / bounds["n"], longest)
        found = rows.mapInArrow(
            _search(index, threshold, question, answer), f"doc_id long, {TEXT_KEY} long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def _item_lengths(batches):
    """The most terms of an item, per chunk."""
    for batch in chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([int(np.bincount(_terms(batch)[1], minlength=1).max())])], ["n"])


def _item_terms(batches):
    """Words and items per term, combined per chunk."""
    for batch in chunks(batches):
        h, row = _terms(batch)
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
        terms, words = np.unique(h, return_counts=True)
        rows = np.add.reduceat(new.astype(np.int64), np.searchsorted(h, terms)) if len(terms) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(words.astype(np.int64)), pa.array(rows)], ["h", "n", "rows"])


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that contain a test item, columns as they were."""
    found = contaminated(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col(TEXT_KEY).alias("_key")).distinct()
    hit = stage(found, "contaminated")
    return docs.join(hit, docs[id_col].cast("long").eqNullSafe(hit["_id"]) & (row_key(text_col) == hit["_key"]), "left_anti")
