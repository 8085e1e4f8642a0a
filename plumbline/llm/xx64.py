"""XXH64 of many byte ranges at once.

Ranges below 32 bytes, nearly all word shingles, are hashed in numpy, one pass
per length; longer ones go to the xxhash library one by one.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
# Fixed values of the published XXH64 specification.
P1, P2, P3, P4, P5 = (
    _U(11400714785074694791),
    _U(14029467366897019727),
    _U(1609587929392839161),
    _U(9650029242287828579),
    _U(2870177450012600261),
)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _same_length(padded: np.ndarray, begin: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of ranges of one length below 32."""
    n = len(padded)
    eight = np.ndarray((n - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((n - 3,), "<u4", padded, strides=(1,))
    h = np.full(len(begin), seed, _U) + P5 + _U(length)
    at = 0
    while at + 8 <= length:
        h ^= _turn(eight[begin + at] * P2, 31) * P1
        h = _turn(h, 27) * P1 + P4
        at += 8
    if at + 4 <= length:
        h ^= four[begin + at].astype(_U) * P1
        h = _turn(h, 23) * P2 + P3
        at += 4
    while at < length:
        h ^= padded[begin + at].astype(_U) * P5
        h = _turn(h, 11) * P1
        at += 1
    h ^= h >> _U(33)
    h *= P2
    h ^= h >> _U(29)
    h *= P3
    return h ^ (h >> _U(32))


def hash_ranges(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of ``data[begin[i]:end[i]]`` for every i."""
    out = np.empty(len(begin), _U)
    lengths = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order = np.argsort(np.minimum(lengths, 32).astype(np.int8), kind="stable")
    cuts = np.searchsorted(np.minimum(lengths, 32)[order], np.arange(34))
    for length in range(32):
        rows = order[cuts[length] : cuts[length + 1]]
        for lo in range(0, len(rows), 1 << 14):
            part = rows[lo : lo + (1 << 14)]
            out[part] = _same_length(padded, begin[part], length, seed)
    if cuts[33] > cuts[32]:
        raw, digest = data.tobytes(), xxhash.xxh64_intdigest
        for i in order[cuts[32] :].tolist():
            out[i] = digest(raw[begin[i] : end[i]], seed)
    return out
