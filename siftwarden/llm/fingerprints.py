"""Fingerprints of all substrings of some lengths, by prefix doubling over a byte buffer."""

import numpy as np

from .common import mix

A, B, C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def pair(left, right):
    """Fingerprint of a string from those of two parts that cover it; order matters."""
    x = left * A
    x += right
    x ^= x >> np.uint64(29)
    x *= B
    return x


def doubled(data, lengths):
    """For each length (a power of two, ascending) the fingerprint of the substring at every position."""
    out, size = {}, 1
    ranks = mix(np.arange(1, 257, dtype=np.uint64))[data]
    for length in lengths:
        while size < length and len(ranks) > size:
            ranks = pair(ranks[:-size], ranks[size:])
            size *= 2
        out[length] = ranks if size == length else ranks[:0]
    return out


def stretch(ranks, unit, start, length):
    """Fingerprints of substrings between ``unit`` and three times ``unit`` long, from those of length ``unit``."""
    first, middle, last = ranks[start], ranks[start + (length - unit) // 2], ranks[start + length - unit]
    return mix(pair(pair(first, middle), last) + length.astype(np.uint64) * C)


def window_minima(values, width):
    """Minimum over each ``width`` neighbouring values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values
