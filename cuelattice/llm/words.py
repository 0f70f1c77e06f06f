"""Words of whole texts as 64-bit hashes, computed over arrays of code points rather than word by word."""

from __future__ import annotations

import numpy as np

_RATIO = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RATIO), -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1 << 16, dtype=np.uint64))


def _reserve(n: int) -> None:
    global _powers, _inverses
    if n > len(_powers):
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _RATIO))])
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _INVERSE))])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lower_ascii(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)


def spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``space`` is false."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span of ``codes``."""
    n = len(codes)
    _reserve(n + 1)
    if n and int(codes.max()) >= len(_TABLE):
        each = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], mix(codes.astype(np.uint64)))
    else:
        each = _TABLE[codes]
    each *= _powers[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(each, out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * _inverses[starts] ^ (ends - starts).astype(np.uint64))


def hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span of ``codes``; equal spans have equal hashes wherever they stand."""
    return span_hashes(prefix(codes), starts, ends)


def ascii_words(text: str) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, in order."""
    codes = lower_ascii(points(text))
    return hashes(codes, *spans((codes == 32) | ((codes >= 9) & (codes <= 13))))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct runs of ``size`` words as sorted hashes; a shorter text is one run of all its words."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) ^ words[i : len(words) - size + 1 + i])
    return np.unique(out)
