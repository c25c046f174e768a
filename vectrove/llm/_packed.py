"""Arrays of whole numbers as small byte strings, for rows that carry many of them."""

from __future__ import annotations

import numpy as np


def pack(counts: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in rising order, as the steps between them."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)
