"""Columns of longs as compressed bytes, so that edges are shuffled in blocks of about two bytes each, not in rows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Differences of neighbours, zigzag, byte planes, zstd; any order, smallest for sorted values."""
    values = np.ascontiguousarray(values, np.int64)
    d = np.diff(values, prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).view(np.uint64)
    planes = z.view(np.uint8).reshape(-1, 8)[:, : max(1, (int(z.max(initial=0)).bit_length() + 7) // 8)]
    return len(values).to_bytes(8, "little") + pa.compress(planes.T.tobytes(), codec="zstd", asbytes=True) + planes.shape[1].to_bytes(1, "little")


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[-1]
    planes = np.frombuffer(pa.decompress(data[8:-1], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    z = np.zeros((n, 8), np.uint8)
    z[:, :width] = planes.T
    z = z.reshape(-1).view(np.uint64)
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


def block_of(ids: np.ndarray, blocks: int, seed: int = 0) -> np.ndarray:
    """A block 0..blocks-1 of each id, by a hash."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.int64).view(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths: the list of every element and its place there."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def bounded(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of a total weight of at most ``most``, or of one element."""
    ends, at = np.cumsum(weights), 0
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def buffered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of several batches together, of about ``rows`` rows."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(c[0]) for c in held) >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in itertools.groupby(rows, lambda r: r[:keys]):
        yield key, list(group)


def dealt(block: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(block, packed columns) of each block, rows sorted by the columns."""
    order = np.lexsort((*columns[::-1], block))
    block, columns = block[order], [c[order] for c in columns]
    ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True][: len(block)]) + 1
    for a, b in zip(np.r_[0, ends], ends):
        yield int(block[a]), *(pack(c[a:b]) for c in columns)
