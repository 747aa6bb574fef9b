"""Word and shingle hashing, shared by the text duplicate operators. Runs inside tasks, on bounded slices."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes that a worker keeps.
KEPT = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > KEPT:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words: a polynomial by doubling, then mixed."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    out, have, part, size, power, rest = None, 0, h, 1, base, k
    while rest:  # part holds runs of `size` words, a power of two; out holds runs of `have` words
        if rest & 1:
            if out is None:
                out, have, out_power = part, size, power
            else:
                n = len(h) - have - size + 1
                out = out[:n] * np.uint64(power) + part[have : have + n]
                have += size
        rest >>= 1
        if rest:
            n = len(h) - 2 * size + 1
            part = part[:n] * np.uint64(power) + part[size : size + n]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            size *= 2
    return mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text in lower case (A to Z only).

    A text of fewer words gives one shingle of all of them; one without words gives none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(k, len(words))))
