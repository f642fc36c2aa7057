"""SentencePiece encoding as a shortest path through a weighted finite-state transducer, and its decoding.

The transducer reads characters and writes piece ids. Three parts are compiled once per model: the normaliser (dummy
prefix, spaces to the space mark), the closure of a trie of pieces whose final states carry an id and the weight -score,
and one arc per byte for characters that no piece covers. Composing it with a text gives an acyclic lattice of text
positions; the path of least weight (tropical semiring) is found in one pass over the positions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelframe.llm.arrays import chunks, list_column

MARK = "▁"
# Fixed values of the public model format: piece types, and the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """What the model file says: pieces with scores and types, and the normaliser's switches."""

    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool = True
    trim: bool = True
    charmap: bytes = b""

    @classmethod
    def parse(cls, model: bytes) -> Pieces:
        out = cls([])
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                out.pieces.append((f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 3:
                f = dict(_fields(value))
                out.dummy_prefix, out.trim, out.charmap = bool(f.get(3, 1)), bool(f.get(4, 1)), f.get(2, b"")
        return out


class Transducer:
    """Compiled from a model file. ``encode`` and ``decode`` work on one text; different segments are computed once."""

    MEMORY = 250_000

    def __init__(self, model: bytes):
        spec = Pieces.parse(model)
        if spec.charmap:
            raise ValueError("models with a character map other than identity are not supported")
        self.dummy_prefix, self.trim = spec.dummy_prefix, spec.trim
        self.root: dict = {}
        self.table: list[str | int] = []  # what an id stands for: a string, or a byte
        self.byte_ids = [-1] * 256
        self.unknown = 0
        inner: set[str] = set()
        scores = [s for _, s, kind in spec.pieces if kind in (NORMAL, USER)]
        self.unknown_weight = UNKNOWN_PENALTY - min(scores, default=0.0)
        top = max(scores, default=0.0)
        for i, (piece, score, kind) in enumerate(spec.pieces):
            self.table.append("" if kind in (CONTROL, UNUSED) else piece.replace(MARK, " "))
            if kind == BYTE:
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.table[i] = i, b
            elif kind == UNKNOWN:
                self.unknown, self.table[i] = i, " ⁇ "
            elif kind in (NORMAL, USER):
                state = self.root
                for c in piece:
                    state = state.setdefault(c, {})
                # a user piece is worth more than anything it covers
                state[""] = (i, -score if kind == NORMAL else -(len(piece) * top - 0.1))
                inner |= set(piece[1:])
                if len(piece) > 1:
                    inner.add("head:" + piece[0])
        self.byte_fallback = min(self.byte_ids) >= 0
        # no piece continues after a letter with one of these: the lattice is a chain of independent segments there
        cuts = [c for c in (MARK, "\n", "\t", "\r") if c not in inner or (c == MARK and not any(MARK in p.lstrip(MARK) for p, _, k in spec.pieces if k in (NORMAL, USER)))]
        alone = "".join(re.escape(c) for c in cuts if c != MARK and f"head:{c}" not in inner)
        mark = MARK if MARK in cuts else ""
        if mark and alone:
            self.segments = re.compile(f"{mark}*[^{mark}{alone}]+|{mark}+|[{alone}]")
        elif mark:
            self.segments = re.compile(f"{mark}*[^{mark}]+|{mark}+")
        else:
            self.segments = re.compile(r"(?s).+")
        self.known: dict[str, list[int]] = {}

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.replace(MARK, " ")).strip(" ")
        text = text.replace(" ", MARK)
        return MARK + text if self.dummy_prefix and text else text

    def _fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "replace")] if self.byte_fallback else [self.unknown]

    def shortest_path(self, s: str) -> list[int]:
        """Ids on the path of least weight through the lattice of ``s``; equal weights: the longer last piece."""
        n, far = len(s), float("inf")
        weight, came, ids = [far] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        weight[0] = 0.0
        root, unknown = self.root, self.unknown_weight
        for i in range(n):
            here, state, single, j = weight[i], root, False, i
            while j < n:
                state = state.get(s[j])
                if state is None:
                    break
                j += 1
                end = state.get("")
                if end is not None:
                    single = single or j == i + 1
                    w = here + end[1]
                    if w < weight[j]:
                        weight[j], came[j], ids[j] = w, i, end[0]
            if not single:
                w = here + unknown
                if w < weight[i + 1]:
                    weight[i + 1], came[i + 1], ids[i + 1] = w, i, -1
        path, at = [], n
        while at:
            path.append((ids[at], came[at], at))
            at = came[at]
        out: list[int] = []
        for i, a, b in reversed(path):
            if i >= 0:
                out.append(i)
            else:
                out += self._fallback(s[a:b])
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for s in self.segments.findall(self.normalise(text)):
            ids = known.get(s)
            if ids is None:
                ids = self.shortest_path(s)
                if len(s) <= 64:
                    if len(known) >= self.MEMORY:
                        known.clear()
                    known[s] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.table
        parts = [table[i] for i in ids]
        if self.byte_ids[0] >= 0 and any(type(p) is int for p in parts):
            text = b"".join(bytes((p,)) if type(p) is int else p.encode() for p in parts).decode("utf-8", "replace")
        else:
            text = "".join(parts)
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_compiled: dict[bytes, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """One compiled transducer per worker process."""
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
    return _compiled[model]


def _encoded(model: bytes):
    def run(batches):
        t = transducer(model)
        for batch in chunks(batches):
            ids, counts, same = [], [], []
            for text in batch.column("text").to_pylist():
                x = t.encode(text)
                ids.append(np.array(x, dtype=np.int32))
                counts.append(len(x))
                same.append(t.decode(x) == (text if not t.trim and MARK not in text else _expected(t, text)))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), list_column(pa.array(flat), np.array(counts, dtype=np.int64)), pa.array(counts, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_ids", "round_trip"])

    return run


def _expected(t: Transducer, text: str) -> str:
    n = t.normalise(text).replace(MARK, " ")
    return n[1:] if t.dummy_prefix and n[:1] == " " else n


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_ids, and round_trip (decoding the ids gives the normalised text again).

    One pass without a shuffle; the model travels with the task. Memory holds one chunk of texts and a bounded table of
    segments. Null and empty texts give no ids. Null ids and repeated rows are encoded like all others.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encoded(model), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column text; null ids give null."""
    names = [c for c in encoded.columns if c != "text"]

    def run(batches):
        t = transducer(model)
        for batch in batches:
            texts = [None if x is None else t.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    rest = encoded.select(*names)
    return rest.mapInArrow(run, rest.withColumn("text", F.lit("")).schema)
