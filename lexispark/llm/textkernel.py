"""Vectorised text primitives over Arrow string columns.

Documents reach Python as Arrow batches; every primitive works on the raw UTF-8 buffer with NumPy, so the cost per
token is tens of nanoseconds and no per-row Python object is made. Nulls count as empty texts. Work is cut into slices
of at most ``SLICE_BYTES`` (a single longer text is cut at token boundaries), which bounds memory whatever a text's length.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: ASCII white space as the contracts give it: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes that cannot stand in an alphanumeric word: ASCII other than digits and letters.
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = False
NON_ALNUM[65:91] = False
NON_ALNUM[97:123] = False

#: ASCII lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_MULT = 0xD6E8FEB86659FD93  # odd, 3 modulo 4
_INV = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_values(seed: int) -> np.ndarray:
    """A pseudorandom uint64 for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class SpanHash:
    """64-bit hashes of byte spans: a polynomial over pseudorandom byte values, finalised with the span's length.

    Two different spans collide with probability about 2^-64.
    """

    def __init__(self, seed: int = 1, fold_case: bool = True):
        values = byte_values(seed)
        self.values = values[LOWER] if fold_case else values
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_MULT, n), _powers(_INV, n)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows with at most ``most`` bytes of text (at least one row each)."""
    data, offsets = buffers(batch.column(text))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not in ``stop``, and n+1 positions of each document's runs."""
    inside = ~stop[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1 : len(data)]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1 : len(data)]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(data: np.ndarray, stop: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of one long text, cut only where a byte of ``stop`` follows."""
    at = 0
    while at < len(data):
        to = at + most
        while to < len(data):
            near = np.flatnonzero(stop[data[to : to + 65536]])
            if len(near):
                to += int(near[0])
                break
            to += 65536
        yield at, min(to, len(data))
        at = min(to, len(data))


def token_hashes(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash, stop: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token in order, and n+1 positions of each document's tokens."""
    if len(data) <= 2 * SLICE_BYTES or len(offsets) != 2:
        starts, ends, at = spans(data, offsets, stop)
        return hasher(data, starts, ends), at
    parts = []
    for lo, hi in pieces(data, stop):
        starts, ends, _ = spans(data[lo:hi], np.array([0, hi - lo]), stop)
        parts.append(hasher(data[lo:hi], starts, ends))
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return out, np.array([0, len(out)])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start, start+1, ... with the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step = np.ones(total, dtype=np.int64)
    step[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    step[at] = starts[1:] - (starts[:-1] + counts[:-1]) + 1
    return np.cumsum(step)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each of the n runs that the n+1 positions bound; empty runs give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between stages, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f: Callable) -> Callable:
    """A mapInArrow function that gives its memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def over_texts(text: str, each: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict], schema: pa.Schema) -> Callable:
    """A mapInArrow function that calls ``each`` on every slice and yields the columns it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                got = each(rows, data, offsets)
                yield pa.RecordBatch.from_arrays([c if isinstance(c := got[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema)

    return run
