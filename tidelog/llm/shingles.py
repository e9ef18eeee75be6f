"""Word shingles of whole texts as sorted sets of 64-bit hashes, with numpy on groups of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in groups of about so many bytes; a group takes some 70 times as many in memory.
GROUP_BYTES = 200_000
#: Bytes of a long text that are handled at a time.
BLOCK = 1 << 16
_rng = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power(name: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[name]) < n:
        base = np.uint64(_BASE if name == "up" else pow(_BASE, -1, 2**64))
        _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * GROUP_BYTES), base)]), dtype=np.uint64)
    return _powers[name][:n]


def forget_powers() -> None:
    """Lets go of powers beyond those of a group of texts; an idle worker would keep them."""
    for name, found in _powers.items():
        _powers[name] = found[: 2 * GROUP_BYTES].copy()


def powers_at(name: str, at: np.ndarray) -> np.ndarray:
    """Powers with some exponents, each as a product of two from short tables."""
    low = power(name, BLOCK)
    return low[at % BLOCK] * _steps(name, int(at.max()) // BLOCK + 1 if len(at) else 0)[at // BLOCK]


def _steps(name: str, n: int) -> np.ndarray:
    """The first n powers whose exponents are multiples of BLOCK."""
    base = np.uint64(pow(_BASE if name == "up" else pow(_BASE, -1, 2**64), BLOCK, 2**64))
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base)]), dtype=np.uint64)[:n]


def sums_before(raw: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """At each byte, and at the end, the sum over all bytes before of the letter's number times the power of its place; beside the sums only a block is held."""
    total = np.zeros(len(raw) + 1, np.uint64)
    low = power("up", BLOCK)
    for i, step in zip(range(0, len(raw), BLOCK), _steps("up", -(-len(raw) // BLOCK)), strict=True):
        part = letter[raw[i : i + BLOCK]]
        part *= low[: len(part)]
        part *= step
        out = np.cumsum(part, out=total[i + 1 : i + 1 + len(part)])
        out += total[i]
    return total


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finish of a common hash function)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in the bytes, and a hash of each; equal words have equal hashes anywhere."""
    raw = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * power("up", len(raw)), out=total[1:])
    hashes = (total[ends] - total[starts]) * power("down", len(raw) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return starts, mix(hashes)


def text_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles (A-Z lower-cased); with fewer words one for all; with none, nothing."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode().lower()
        if group and size + len(data) > GROUP_BYTES:
            yield from _group_sets(group, k)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    yield from _group_sets(group, k)


def _group_sets(group: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not group:
        return
    starts, words = word_hashes(b"\n".join(group))
    first = np.cumsum([0] + [len(g) + 1 for g in group])
    cut = np.searchsorted(starts, first)
    n = len(words) - k + 1
    if n > 0:
        all_of = np.zeros(n, np.uint64)
        for j in range(k):
            all_of += words[j : j + n] * _PLACE[j]
        all_of = mix(all_of)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(all_of[a : b - k + 1])
            yield s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            h = np.full(1, b - a, np.uint64) * _PLACE[63]
            for j in range(b - a):
                h += words[a + j : a + j + 1] * _PLACE[j : j + 1]
            yield mix(h)
        else:
            yield words[:0]


def batches_of(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a column of strings or binaries each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most or i + 1 == len(batch):
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists of 64-bit integers."""
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
