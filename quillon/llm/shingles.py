"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle is ``width`` words, or all words of a
text with fewer. Two shingles pass for equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
#: Texts are hashed together up to about so many bytes.
CHUNK = 1 << 20

_CODE = np.arange(256, dtype=np.uint64)
_CODE[65:91] += _U(32)
_CODE = (_CODE + _U(1)) * _U(0xFF51AFD7ED558CCD)
_CODE ^= _CODE >> _U(29)
_CODE *= _U(0xC4CEB9FE1A85EC53)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False

_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a public hash family."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; those for very long texts are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p, out=p))
    if n <= 2 * CHUNK:
        _powers[:] = made
    return made[0], made[1]


def chunks(texts: list[bytes]):
    """Index ranges of texts of about CHUNK bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[bytes], width: int = 5):
    """The sorted distinct shingle hashes of each text, in order."""
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        power, inverse = _tables(len(data) + 1)
        word = _IS_WORD[data]
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
        start, end = edge[::2], edge[1::2]  # the last byte is a delimiter
        total = np.concatenate(([_U(0)], np.cumsum(_CODE[data] * power[: len(data)], dtype=np.uint64)))
        words = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(t) + 1 for t in part])
        first = np.searchsorted(start, np.concatenate(([0], ends)))
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * _U(_STEP) + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                h = _U(b - a)
                for w in words[a:b]:
                    h = np.array([h], np.uint64) * _U(_STEP) + w
                    h = h[0]
                yield mix(np.array([h], np.uint64) ^ _U(0x5555555555555555))
            else:
                yield np.zeros(0, np.uint64)
