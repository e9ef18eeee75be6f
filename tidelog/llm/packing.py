"""Sorted numbers as compressed bytes."""

from __future__ import annotations

import numpy as np


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers by planes of bytes, as many as the largest needs, compressed: the high planes are nearly constant."""
    import zstandard

    wide = np.ascontiguousarray(numbers, np.uint64).view(np.uint8).reshape(-1, 8)
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + len(numbers).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide[:, :width].T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    import zstandard

    width, n = data[0], int.from_bytes(data[1:5], "little")
    if not n:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, width * n)), np.uint8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = body.reshape(width, n).T
    return wide.reshape(-1).view(np.uint64)


def pack(names: np.ndarray) -> bytes:
    """Sorted numbers as the first and the gaps."""
    return names[:1].tobytes() + planes(np.diff(names))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), from_planes(data[8:])]), dtype=np.uint64)
