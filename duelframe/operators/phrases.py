"""Many phrases looked up in many texts at once: an Aho-Corasick automaton as one table, stepped by whole batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

PART_BYTES = 1 << 17  # phrase bytes of one automaton; its table has at most as many rows as these bytes


class PhraseAutomaton:
    """States are the prefixes of the phrases; a cell holds the longest suffix that is a prefix after reading one more byte."""

    def __init__(self, phrases: list[bytes]):
        self.classes = np.zeros(256, dtype=np.int64)  # bytes that no phrase holds share class 0
        used = sorted({b for p in phrases for b in p})
        self.classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for n, phrase in enumerate(phrases):
            at = 0
            for c in self.classes[list(phrase)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][c]
            ends[at].append(n)
        self.table = np.zeros((len(children), len(used) + 1), dtype=np.int32)
        self.shorter = np.zeros(len(children), dtype=np.int32)  # the next shorter suffix at which a phrase ends, 0 for none
        fall = np.zeros(len(children), dtype=np.int32)
        todo = deque([0])
        while todo:
            s = todo.popleft()
            if s:
                self.table[s] = self.table[fall[s]]
                self.shorter[s] = fall[s] if ends[fall[s]] else self.shorter[fall[s]]
            for c, child in children[s].items():
                fall[child] = self.table[s, c]
                self.table[s, c] = child
                todo.append(child)
        self.ends = ends
        self.found = np.array([bool(e) for e in ends]) | (self.shorter > 0)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, phrase) numbers of all phrases in texts that lie one after the other in ``data``, each pair once."""
        letters = self.classes[data]
        state = np.zeros(len(offsets) - 1, dtype=np.int32)
        live, place, seen = np.flatnonzero(np.diff(offsets)), 0, []
        while len(live):
            now = self.table[state[live], letters[offsets[live] + place]]
            state[live] = now
            ended = self.found[now]
            if ended.any():
                seen.append(np.unique(live[ended].astype(np.int64) * len(self.table) + now[ended]))
            place += 1
            live = live[offsets[live + 1] - offsets[live] > place]
        pairs = set()
        for cell in (np.unique(np.concatenate(seen)).tolist() if seen else []):
            text, s = divmod(cell, len(self.table))
            while s:
                pairs.update((text, n) for n in self.ends[s])
                s = int(self.shorter[s])
        found = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def phrases_in(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(text, phrase): every distinct text with every phrase inside it, byte for byte.

    The phrases go to all tasks as automata of about ``part_bytes``; more phrases are dealt by hash into parts of that
    size, one pass over the texts for each. Null texts, null and empty phrases match nothing.
    """
    known = phrases.select(F.col(phrase).alias("_p")).where(F.length("_p") > 0).distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("_p")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    rows = texts.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    found = None
    for part in range(parts):
        mine = [r[0] for r in known.where(F.pmod(F.xxhash64("_p"), F.lit(parts)) == part).collect()]  # about part_bytes
        if mine:
            hit = rows.mapInArrow(_finder(sorted(mine)), "_t string, _p string")
            found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = texts.sparkSession.createDataFrame([], "_t string, _p string")
    return found.select(F.col("_t").alias(text), F.col("_p").alias(phrase))


def _finder(phrases: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = PhraseAutomaton([p.encode() for p in phrases])
        names = pa.array(phrases, pa.string())
        for batch in batches:
            column = pa.concat_arrays([batch.column(0).cast(pa.large_binary())])
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            text, phrase = automaton.hits(data, offsets)
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(text)), pc.take(names, pa.array(phrase))], ["_t", "_p"])

    return run
