"""Vectorised helpers for Arrow batches: words, hashes and minimisers of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2 << 20
SECTION = 1 << 20
PLACE_BITS = 22  # a fixed number, so that the same window picks the same place whatever surrounds it
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, SECTION + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, dtype=U)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: the hash of data[i:j] is (p[j] - p[i]) * down[i]."""
    up, _ = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=p[1:])
    return p


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending spans, in sections so that memory stays bounded."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SECTION, "right")))
        part = data[base : int(ends[j - 1])]
        p, down = prefix_sums(part), _powers(len(part) + 1)[1]
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (p[e] - p[s]) * down[s]
        i = j
    return mix64(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text; one long text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(slot)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def text_bytes(batch: pa.RecordBatch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column in one array, and the row offsets in it; null counts as empty."""
    column = batch.column(text)
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    column = pc.fill_null(column, empty).cast(pa.large_binary())
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross rows: starts, ends and the row of each."""
    n = len(inside)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each row."""
    return spans(~_SPACE[data], offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive items; the last width - 1 places have none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    g = np.zeros(n, dtype=U)
    for j in range(width):
        g = g * U(_BASE) + h[j : j + n]
    return mix64(g)


def window_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` places the place of its smallest hash, the leftmost among equals.

    Block-wise running minima from both sides; a place's hash and its number share one 64-bit key.
    """
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    step = (1 << PLACE_BITS) - width
    if n > step:
        parts = [window_minimum(g[a : a + step + width - 1], width) + a for a in range(0, n, step)]
        return np.concatenate(parts)
    bits = U(PLACE_BITS)
    key = ((g >> bits) << bits) | np.arange(len(g), dtype=U)
    padded = np.full(-(-len(g) // width) * width, np.iinfo(U).max, dtype=U)
    padded[: len(g)] = key
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    return (least & ((U(1) << bits) - U(1))).astype(np.int64)


def super_runs(h: np.ndarray, row: np.ndarray, k: int, m: int, g: np.ndarray | None = None):
    """Maximal runs of consecutive k-windows of one row that share their minimising m-gram.

    ``g`` are the hashes of the m-grams where the caller has them. Returns first window, last window, place of the
    m-gram and its hash, as arrays over runs.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(h) < k:
        return none, none, none, np.zeros(0, dtype=U)
    g = shingle_hashes(h, m) if g is None else g
    place = window_minimum(g, k - m + 1)
    ok = row[: len(place)] == row[k - 1 : k - 1 + len(place)]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, np.zeros(0, dtype=U)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return first, last, place[first], g[place[first]]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a partition sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        tail = int(np.searchsorted(keys, keys[-1], "left"))
        if tail and (held or tail < batch.num_rows):
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = [batch.slice(tail)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def list_column(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    edges = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), values)
