"""Words of many texts at once, as Arrow and numpy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20  # texts handled together; one longer text forms a piece of its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def pieces(batch: pa.RecordBatch, column: int = 1, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts stay below the limit, or single rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words (maximal runs outside space and U+0009 .. U+000D) of all texts, and their number per text.

    Null texts have no words. With `lower`, A-Z become a-z.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]] if raw is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    solid = ~_SPACE[data]
    start = solid.copy()
    if len(data):
        opens = np.zeros(len(data), bool)
        opens[ends[:-1][ends[:-1] < ends[1:]]] = True
        start[1:] &= ~solid[:-1] | opens[1:]
    at = np.flatnonzero(start)
    kept = data[solid]
    offsets = np.empty(len(at) + 1, np.int32)
    offsets[:-1] = np.cumsum(solid, dtype=np.int32)[at] - 1
    offsets[-1] = len(kept)
    if lower:
        kept = _LOWER[kept]
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, np.diff(np.searchsorted(at, ends))


def coded(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct words and the code of each word."""
    d = words.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    distinct, codes = coded(words)
    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(w) for w in distinct), np.uint64, len(distinct))[codes]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n words that begin at each position (len(h) - n + 1 values), by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, size, out, have = mixed(h, seed), 1, None, 0
    while True:
        if n & size:  # the words from `have` on are covered by a power-sized gram
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - have)
                out = mixed(out[:m] * np.uint64(0x9E3779B97F4A7C15) + power[have:have + m], seed)
            have += size
        if have == n:
            return out[:len(h) - n + 1]
        m = len(power) - size
        power = mixed(power[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + power[size:], seed)
        size *= 2


def owners(counts: np.ndarray) -> np.ndarray:
    """Number of the text that each word belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def joined(found: pa.Array, counts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Of each text the words marked in `keep`, joined by one space."""
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1).astype(np.int64)
    raw = found.buffers()[2]
    data = np.frombuffer(raw, np.uint8, ends[-1]) if raw is not None else np.empty(0, np.uint8)
    sizes = np.diff(ends)
    data, sizes = data[np.repeat(keep, sizes)], sizes[keep]
    left = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(counts)])])
    # one space after every word but the last of its text
    first = np.concatenate([[0], np.cumsum(left)])
    space = np.ones(len(sizes), np.int64)
    space[first[1:][left > 0] - 1] = 0
    stop = np.cumsum(sizes + space)
    out = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[(stop - 1)[space == 1]] = False
    out[body] = data
    offsets = np.concatenate([[0], stop])[first].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
