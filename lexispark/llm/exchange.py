"""What the block-and-bucket exchanges share: compact arrays, and cutting sorted keys among buckets.

A block (some megabytes of text) sends each bucket one row with all its distinct keys; a bucket answers each block with one
row in the order asked. Rows are bounded on both sides whatever a key's frequency, since keys are counted before they leave.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa


def encode(a: np.ndarray) -> bytes:
    """Non-negative integers as byte planes of the least width, compressed."""
    a = np.asarray(a)
    most = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    raw = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(raw).to_bytes(5, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def decode(b: bytes) -> np.ndarray:
    width, size = b[0], int.from_bytes(b[1:6], "little")
    if not size:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(pa.decompress(b[6:], size, codec="zstd"), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}")[:, 0].astype(np.int64)


def encode_floats(a: np.ndarray) -> bytes:
    """Doubles as their distinct values and numbers into them."""
    values, at = np.unique(a, return_inverse=True)
    return pickle.dumps((values.tobytes(), encode(at)), protocol=5)


def decode_floats(b: bytes) -> np.ndarray:
    values, at = pickle.loads(b)
    return np.frombuffer(values, dtype=np.float64)[decode(at)]


def pack(**arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def key_cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Positions that cut sorted uint64 keys into ``buckets`` equal ranges of the key space (buckets + 1 of them)."""
    edges = [min((b << 64) // buckets + (b > 0), (1 << 64) - 1) for b in range(buckets)]
    return [*map(int, np.searchsorted(keys, np.array(edges, dtype=np.uint64))), len(keys)]


def encode_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys by their differences."""
    return encode(np.diff(keys, prepend=np.uint64(0)))


def decode_keys(b: bytes) -> np.ndarray:
    return np.cumsum(decode(b).view(np.uint64), dtype=np.uint64)
