"""Toxicity scores from a learned lexicon, found with Levenshtein automata and weighed in context.

The lexicon (whole words and word stems) is learned from labelled documents. Its trie intersected with the Levenshtein
automaton is one table of states and letters, through which the different words of a batch move letter by letter; the
state a word ends in tells whether an entry lies within the allowed number of edits. Hits are counted by kind (exact, misspelled, stem) and by context (inside quotation marks or after a reporting
word, against used as the writer's own), and a logistic model turns the counts into a score.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Collection, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelframe.llm.arrays import chunks, lower_ascii, span_hashes, spans, text_bytes
from duelframe.llm.staging import stage

KINDS = ("exact", "stem", "near", "far")
FEATURES = [f"{kind}_{use}" for kind in KINDS for use in ("own", "quoted")]
STEM_LENGTHS = (4, 5, 6, 7, 8)
DIGEST = ("d0", "d1", "d2", "d3")
# Bytes that belong to words besides those above 127, quotation marks, and words that report speech.
QUOTES = ('"', "“", "”", "«", "»", "„")
REPORTING = ("said", "says", "wrote", "writes", "called", "quoted", "quote", "according")

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def edits_allowed(length: int) -> int:
    """Misspellings allowed for an entry: none below five letters, one up to eight, two beyond."""
    return 0 if length < 5 else 1 if length <= 8 else 2


def fold(word: str) -> str:
    return word.lower()


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]
    bias: float


class Node:
    """A trie node: children by letter, what ends here, and the most edits that any entry at or below it allows."""

    __slots__ = ("children", "word", "stem", "report", "edits")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.word: str | None = None
        self.stem = self.report = False
        self.edits = 0


class Automaton:
    """The lexicon's trie intersected with the Levenshtein automaton, compiled to a table of states and letters.

    A state is a set of (trie node, edits so far) that the letters read so far can lead to, and whether a stem began the
    word. A node may also wait for the letter with which two neighbours changed places. States and table cells come into
    being when a word first needs them; then every word of a batch moves through the table with one array step a letter.
    """

    MOST_STATES = 100_000

    def __init__(self, model: Model):
        self.root = Node()
        for words, kind in ((model.words, "word"), (model.stems, "stem"), ([fold(w) for w in REPORTING], "report")):
            for entry in words:
                allowed = min(2, edits_allowed(len(entry))) if kind == "word" else 0
                node = self.root
                for c in entry:
                    node.edits = max(node.edits, allowed)
                    node = node.children.setdefault(c, Node())
                node.edits = max(node.edits, allowed)
                setattr(node, kind, entry if kind == "word" else True)
        self.letters = np.array(sorted({ord(c) for e in (*model.words, *model.stems, *map(fold, REPORTING)) for c in e}), dtype=np.uint32)
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.states: list = []
        self.ends: list[tuple[int, str | None, int]] = []
        self.table = np.full((64, len(self.letters) + 1), -1, dtype=np.int32)
        self.dead = {self._state({}, False), self._state({}, True)}
        self.start = self._state({(self.root, None): 0}, self.root.stem)

    def _state(self, held: dict, stem: bool) -> int:
        """The number of the state of these (node, awaited letter) with their edits; letters that a word may lack are skipped."""
        todo = list(held.items())
        while todo:
            (node, wanted), e = todo.pop()
            if wanted is None and held[node, None] == e:
                for child in node.children.values():
                    if e + 1 <= child.edits and held.get((child, None), 9) > e + 1:
                        held[child, None] = e + 1
                        todo.append(((child, None), e + 1))
        key = frozenset((id(n), w, e) for (n, w), e in held.items()), stem
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append((held, stem))
            ended = [(e, n.word) for (n, w), e in held.items() if w is None and n.word is not None and e <= min(2, edits_allowed(len(n.word)))]
            best = min(ended, default=(0, None))
            exact = any(e == 0 and w is None and n.word is not None for (n, w), e in held.items())
            report = any(e == 0 and w is None and n.report for (n, w), e in held.items())
            kind = 1 if exact else 5 if report else 2 if stem else 2 + min(best[0], 2) if best[1] is not None else 0
            self.ends.append((kind, best[1], best[0]))
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.number[key]

    def _move(self, state: int, letter: int) -> int:
        held, stem = self.states[state]
        c = chr(self.letters[letter - 1]) if letter else ""
        out: dict = {}

        def put(node: Node, wanted: str | None, e: int) -> None:
            if e <= node.edits and out.get((node, wanted), 9) > e:
                out[node, wanted] = e

        for (node, wanted), e in held.items():
            if wanted is not None:
                if wanted == c:
                    put(node, None, e)
                continue
            put(node, None, e + 1)  # a letter too many
            for first, child in node.children.items():
                put(child, None, e + (first != c))
                if first != c and c in child.children:
                    put(child.children[c], first, e + 1)  # two letters changed places
        return self._state(out, stem or any(e == 0 and w is None and n.stem for (n, w), e in out.items()))

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state in which each word ends; a word is a span of ``codes`` (Unicode numbers)."""
        if len(self.states) > self.MOST_STATES:
            self.clear()
        at = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        letter = np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else np.zeros(len(codes), dtype=np.int64)
        state = np.full(len(starts), self.start, dtype=np.int32)
        dead = np.array(sorted(self.dead))
        live, place = np.flatnonzero(ends > starts), 0
        while len(live):
            here, read = state[live], letter[starts[live] + place]
            after = self.table[here, read]
            if (after < 0).any():
                for cell in np.unique(here[after < 0].astype(np.int64) * self.table.shape[1] + read[after < 0]).tolist():
                    s, x = divmod(cell, self.table.shape[1])
                    to = self._move(s, x)
                    self.table[s, x] = to
                after = self.table[here, read]
            state[live] = after
            place += 1
            live = live[(ends[live] - starts[live] > place) & ~np.isin(after, dead)]
        return state

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The whole-word entry with the fewest edits from ``word``, within what its length allows; ties: first in the alphabet."""
        _, entry, edits = self.ends[int(self.run(*_spelled([word]))[0])]
        return (entry, edits) if entry is not None else None


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), ends - sizes, ends


class Matcher:
    """Kinds of the words of a batch; each different word of it moves through the automaton once."""

    def __init__(self, model: Model):
        self.automaton = Automaton(model)

    def kind(self, word: str) -> int:
        """0 none, 1 exact, 2 stem, 3 one edit, 4 more edits, 5 a reporting word."""
        return self.automaton.ends[int(self.automaton.run(*_spelled([word]))[0])][0]

    def kinds(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        different, first, back = np.unique(h, return_index=True, return_inverse=True)
        s, size = starts[first], (ends - starts)[first] + 1
        stop = np.cumsum(size)
        joined = data[np.minimum(np.repeat(s - (stop - size), size) + np.arange(stop[-1]), len(data) - 1)]
        joined[stop - 1] = 10  # no word holds a line break
        codes = np.frombuffer(fold(joined.tobytes().decode("utf-8", "ignore")).encode("utf-32-le"), dtype=np.uint32)
        breaks = np.flatnonzero(codes == 10)
        state = self.automaton.run(codes, np.append(0, breaks[:-1] + 1), breaks)
        return np.array([e[0] for e in self.automaton.ends], dtype=np.int8)[state][back]


_compiled: dict[tuple, Matcher] = {}


def matcher_of(model: Model) -> Matcher:
    """One compiled automaton per worker process."""
    key = tuple(model.words), tuple(model.stems)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Matcher(model)
    return _compiled[key]


def _places(raw: bytes, part: bytes) -> np.ndarray:
    """Where ``part`` starts in ``raw``."""
    return np.array([m.start() for m in re.finditer(re.escape(part), raw)], dtype=np.int64)


def quoted_words(data: np.ndarray, raw: bytes, offsets: np.ndarray, starts: np.ndarray, row: np.ndarray, reporting: np.ndarray, at: np.ndarray, reach: int = 6) -> np.ndarray:
    """Whether the words ``at`` are quoted: after an odd number of quotation marks in their line, or at most ``reach`` words after a reporting word of their text."""
    marks = np.sort(np.concatenate([_places(raw, q.encode()) for q in QUOTES]))
    breaks = np.append(-1, np.flatnonzero(data == 10))
    line = np.maximum(offsets[row[at]], breaks[np.searchsorted(breaks, starts[at]) - 1] + 1)
    inside = (np.searchsorted(marks, starts[at]) - np.searchsorted(marks, line)) % 2 == 1
    said = np.append(0, np.cumsum(reporting))
    return inside | (said[at] > said[np.maximum(np.searchsorted(row, row[at]), at - reach)])


def hit_counts(batch: pa.RecordBatch, matcher: Matcher) -> np.ndarray:
    """Counts of hits per document and feature."""
    data, offsets = text_bytes(batch)
    data = lower_ascii(data)
    starts, ends, row = spans(_WORD[data], offsets)
    out = np.zeros((batch.num_rows, len(FEATURES)))
    if not len(starts):
        return out
    kinds = matcher.kinds(data, starts, ends, span_hashes(data, starts, ends))
    hits = np.flatnonzero((kinds > 0) & (kinds < 5))
    if len(hits):
        quoted = quoted_words(data, data.tobytes(), offsets, starts, row, kinds == 5, hits)
        np.add.at(out, (row[hits], 2 * (kinds[hits] - 1) + quoted), 1)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Hits count with their logarithm: the tenth says less than the first."""
    return np.log2(1.0 + counts)


def _terms():
    """(term, stem, toxic) with document counts of words and stems in labelled texts, combined per chunk.

    Quoted words are left out: who quotes a term is no evidence of what its own use means.
    """
    def run(batches):
        reports = {fold(w) for w in REPORTING}
        for batch in chunks(batches):
            data, offsets = text_bytes(batch)
            data = lower_ascii(data)
            starts, ends, row = spans(_WORD[data], offsets)
            toxic = batch.column("toxic").to_pylist()
            raw, count = data.tobytes(), {}
            words = [fold(raw[s:e].decode("utf-8", "ignore")) for s, e in zip(starts.tolist(), ends.tolist())]
            quoted = quoted_words(data, raw, offsets, starts, row, np.array([w in reports for w in words], dtype=bool), np.arange(len(words))).tolist() if words else []
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for r in range(batch.num_rows):
                seen = {words[i] for i in range(edges[r], edges[r + 1]) if not quoted[i]}
                terms = {(w, False) for w in seen if 3 <= len(w) <= 40} | {(w[:n], True) for w in seen for n in STEM_LENGTHS if len(w) >= n}
                for t in terms:
                    c = count.setdefault(t, [0, 0])
                    c[toxic[r]] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in count], pa.string()), pa.array([s for _, s in count], pa.bool_()),
                 pa.array([c[1] for c in count.values()], pa.int64()), pa.array([c[0] for c in count.values()], pa.int64())],
                ["term", "stem", "bad", "good"])

    return run


def _terms_of_rows(batch: pa.RecordBatch, words: set[str], stems: set[str]):
    """For every row of a chunk its id and those of the given terms that it holds."""
    data, offsets = text_bytes(batch)
    data = lower_ascii(data)
    starts, ends, row = spans(_WORD[data], offsets)
    raw = data.tobytes()
    edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
    ids = batch.column("doc_id").to_pylist()
    for r in range(batch.num_rows):
        seen = {fold(raw[s:e].decode("utf-8", "ignore")) for s, e in zip(starts[edges[r] : edges[r + 1]].tolist(), ends[edges[r] : edges[r + 1]].tolist())}
        yield ids[r], [(w, False) for w in seen & words] + [(p, True) for p in {w[:n] for w in seen for n in STEM_LENGTHS if len(w) >= n} & stems]


def _split(terms: pa.Table) -> tuple[set[str], set[str]]:
    listed = list(zip(terms.column("term").to_pylist(), terms.column("stem").to_pylist()))
    return {t for t, s in listed if not s}, {t for t, s in listed if s}


def _set_digests(terms: pa.Table):
    """For each candidate term four sums over 32-bit parts of the digests of its bearers' ids, combined per chunk.

    Sums of parts cannot overflow or cancel, so terms agree in all four where their bearers do (128 bits).
    """
    def run(batches):
        words, stems = _split(terms)
        for batch in chunks(batches):
            total: dict[tuple[str, bool], np.ndarray] = {}
            for i, found in _terms_of_rows(batch, words, stems):
                parts = np.frombuffer(hashlib.blake2b(str(i).encode(), digest_size=16).digest(), dtype="<u4").astype(np.int64)
                for t in found:
                    if t in total:
                        total[t] += parts
                    else:
                        total[t] = parts.copy()
            sums = np.array(list(total.values()), dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in total], pa.string()), pa.array([s for _, s in total], pa.bool_()), *[pa.array(sums[:, i]) for i in range(4)]],
                ["term", "stem", *DIGEST])

    return run


def _bearers(terms: pa.Table):
    """For each given term the toxic documents that hold it, combined per chunk."""
    def run(batches):
        words, stems = _split(terms)
        for batch in chunks(batches):
            held: dict[tuple[str, bool], list[int]] = {}
            for i, found in _terms_of_rows(batch, words, stems):
                for t in found:
                    held.setdefault(t, []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in held], pa.string()), pa.array([s for _, s in held], pa.bool_()), pa.array(list(held.values()), pa.list_(pa.int64()))],
                ["term", "stem", "ids"])

    return run


def _rows_with_counts(model: Model):
    def run(batches):
        matcher = matcher_of(model)
        for batch in chunks(batches):
            x = hit_counts(batch, matcher)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", "toxic", *FEATURES])

    return run


def choose_entries(bearers: Iterable[tuple[tuple[str, bool], Collection[int]]], least: int, most: int) -> list[tuple[str, bool]]:
    """Greedy cover: the term that explains most toxic documents which no chosen term explains yet.

    Words that merely occur in copies of a toxic document explain nothing new and are not chosen. Ties: whole words
    before stems, longer before shorter, then the alphabet. ``bearers`` come by number of documents, largest first, and
    in that order among equals. What a term explains anew never grows, so terms are read only while the next could still
    win, and those that explain fewer than ``least`` are dropped for good.
    """
    def place(term, n):
        return (-n, term[1], -len(term[0]), term[0])

    source, covered, chosen = iter(bearers), set(), []
    heap: list[tuple[tuple, set[int]]] = []
    following = next(source, None)
    while len(chosen) < most:
        while following and (not heap or place(following[0], len(following[1])) < heap[0][0]):
            left = set(following[1]) - covered
            if len(left) >= least:
                heapq.heappush(heap, (place(following[0], len(left)), left))
            following = next(source, None)
        if not heap:
            break
        at, left = heapq.heappop(heap)
        now = left - covered
        if len(now) < len(left):
            if len(now) >= least:
                heapq.heappush(heap, ((-len(now), *at[1:]), now))
            continue
        covered |= now
        chosen.append((at[3], at[1]))
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, floor: bool = True, steps: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method; with ``floor`` no weight is negative (a hit never lowers a score)."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    free = np.ones(len(w), dtype=bool)
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w = w - step
        if floor:
            below = np.append(w[:-1] < 0, False)
            w[below] = 0.0
            free &= ~below
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, entries: int = 500, precision: float = 0.98,
) -> Model:
    """Fit lexicon and weights on at most ``sample`` labelled rows, taken by a hash of the id.

    Bounds of the lexicon: at most ``entries`` terms; a term is a word of 3 to 40 letters or a stem of 4 to 8, used (not
    quoted) in at least max(3, 0.4 %) of the toxic texts and with a share of toxic texts of at least ``precision`` among its
    users, both classes weighed alike. Misspellings are looked for in words of any length.

    Equal texts count once. Labels other than 0 and 1 are ignored. Without both classes the lexicon stays empty and every
    score is the share of toxic labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # at most ``sample`` short rows, so they can go to every task and no text is shuffled
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stage(rows, "labelled-texts")
    first = rows.groupBy(F.md5("text").alias("h"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    rows = rows.join(first, ["doc_id", "toxic"], "left_semi")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1)
        return Model([], [], [0.0] * len(FEATURES), math.log(share / (1 - share)))
    least = max(3, int(0.004 * bad))
    counted = rows.mapInArrow(_terms(), "term string, stem boolean, bad long, good long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # the share of toxic documents among the bearers, with the classes weighed alike
    even = (F.col("bad") / bad) / (F.col("bad") / bad + F.col("good") / good)
    terms = counted.where((F.col("bad") >= least) & (even >= precision)).select("term", "stem").toArrow()
    toxic = rows.where("toxic = 1")
    # of terms with equal bearers the cover can choose only the first of its order, so one stands for all
    digests = toxic.mapInArrow(_set_digests(terms), "term string, stem boolean, " + ", ".join(f"{d} long" for d in DIGEST)).groupBy("term", "stem").agg(*[F.sum(d).alias(d) for d in DIGEST])
    foremost = digests.groupBy(*DIGEST).agg(F.min(F.struct("stem", (-F.length("term")).alias("length"), "term")).alias("first"))
    terms = foremost.select("first.term", "first.stem").toArrow()
    found = toxic.mapInArrow(_bearers(terms), "term string, stem boolean, ids array<long>").groupBy("term", "stem").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    found = found.orderBy(F.desc(F.size("ids")), "stem", F.desc(F.length("term")), "term")
    lexicon = choose_entries((((r["term"], r["stem"]), r["ids"]) for r in found.toLocalIterator()), least, entries)
    model = Model([t for t, s in lexicon if not s], [t for t, s in lexicon if s], [0.0] * len(FEATURES), 0.0)
    schema = "doc_id long, toxic int, " + ", ".join(f"{f} double" for f in FEATURES)
    table = rows.mapInArrow(_rows_with_counts(model), schema).groupBy("toxic", *FEATURES).agg(F.count(F.lit(1)).alias("n")).toPandas()
    times = table["n"].to_numpy()
    x, y = np.repeat(features(table[FEATURES].to_numpy()), times, axis=0), np.repeat(table["toxic"].to_numpy(), times)
    weights, bias = fit_logistic(x, y)
    return Model(model.words, model.stems, [float(w) for w in weights], bias)


def _scores(model: Model, id_cols: list[str]):
    def run(batches):
        matcher, w = matcher_of(model), np.array(model.weights)
        for batch in chunks(batches):
            counts = hit_counts(batch, matcher)
            p = 1 / (1 + np.exp(-np.clip(features(counts) @ w + model.bias, -30, 30)))
            own, quoted = counts[:, 0::2].sum(axis=1), counts[:, 1::2].sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in id_cols], pa.array(p), pa.array(own.astype(np.int64)), pa.array(quoted.astype(np.int64))], [*id_cols, "score", "own_hits", "quoted_hits"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, own_hits, quoted_hits. Scoring is one pass without a shuffle.

    Null and empty texts score as texts without hits; null ids and repeated rows are scored like all others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scores(model, ["doc_id"]), "doc_id long, score double, own_hits long, quoted_hits long")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more, all columns as they were, in one pass."""
    schema = docs.schema

    def run(batches):
        matcher, w = matcher_of(model), np.array(model.weights)
        for batch in chunks(batches, text_col):
            counts = hit_counts(batch.select([text_col]).rename_columns(["text"]), matcher)
            p = 1 / (1 + np.exp(-np.clip(features(counts) @ w + model.bias, -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, schema)
