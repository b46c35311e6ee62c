"""Words and word windows of whole batches of texts as flat numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D, taken unchanged from the UTF-8 text (the separators are
ASCII, so they never cut a character). Null texts count as empty. All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {int(_BASE): np.ones(1, np.uint64), int(_INVERSE): np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    if len(_powers[int(base)]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return _powers[int(base)][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of some ``limit`` bytes of text, one row at least: bounds the memory of a task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            until = max(until, at + 1)
            yield batch.slice(at, until - at)
            at = until


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text begins, with the end of the last."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[raw]


def words(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (one more entry at the end)."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[texts] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, texts)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = within(lengths)
    marks = _BYTE[raw[at + np.repeat(starts, lengths)]] * powers(_BASE, int(lengths.max()))[at]
    return mix(np.add.reduceat(marks, np.cumsum(lengths) - lengths) ^ lengths.astype(np.uint64))


def windows(hashes: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words, its first word, and the number of each text's first window."""
    counts = np.maximum(np.diff(texts) - size + 1, 0)
    first = within(counts) + np.repeat(texts[:-1], counts)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), dtype=np.uint64, out=total[1:])
    value = (total[first + size] - total[first]) * powers(_INVERSE, len(hashes) + 1)[first]
    return mix(value ^ np.uint64(size)), first, np.concatenate([[0], np.cumsum(counts)])


def gather(flat_values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``counts`` values beginning at ``starts``, one after another."""
    return flat_values[within(counts) + np.repeat(starts, counts)]
