"""Vectorised hashes of words, shingles and substrings, for use inside tasks.

All hashes are 64-bit and depend on the bytes alone: the same in every task, process and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240117))
_odd = lambda n: _RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_odd(1)[0])
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_BASE = np.uint64(_BASE)
_BYTE = _odd(256)
_PLACE = _odd(64)
_STEP = _odd(1024)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the splitmix64 finaliser's factors

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2**64; grown in doubling steps and kept."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE))
    return _powers


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which :func:`span_hash` reads the hash of any stretch of ``values`` (uint64)."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``blob``; ASCII capitals count as small letters."""
    data = np.frombuffer(blob.translate(_FOLD), np.uint8)
    gap = np.empty(len(data) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    return start, span_hash(prefix_sums(_BYTE[data]), start, end)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` words, in order; shorter texts give one for the whole, no words none."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        total = total + words[j : n - width + 1 + j] * _PLACE[j]
    return mix(total)


def shingle_sets(texts: list[str | None], k: int, chunk: int = 1 << 19) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; texts are hashed together in chunks of bytes."""
    held: list[bytes] = []
    size = 0

    def flush():
        blob = b"\n".join(held)
        ends = np.cumsum([len(x) + 1 for x in held])
        start, h = word_hashes(blob)
        cut = np.searchsorted(start, ends)
        low = 0
        for high in cut:
            yield np.unique(shingles(h[low:high], k))
            low = high

    for t in texts:
        b = (t or "").encode()
        if held and size + len(b) > chunk:
            yield from flush()
            held, size = [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield from flush()


def minima(hashes: np.ndarray, n: int, block: int = 1 << 15) -> np.ndarray:
    """``n`` minhash values of a set of hashes."""
    least = np.full(n, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), block):
            part = hashes[at : at + block]
            least = np.minimum(least, ((part[None, :] ^ _STEP[:n, None]) * _STEP[n : 2 * n, None] >> np.uint64(1)).min(axis=1))
    return least


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
