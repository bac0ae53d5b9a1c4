"""Hashes of words and of runs of words, for whole texts at a time.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z
lower-cased.  Words are hashed without being cut out: prefix sums of
``value(byte) * BASE ** position`` give every word's sum as a difference, and a
power of the inverse of ``BASE`` moves it to position 0.  All arithmetic is
modulo 2 ** 64; byte values are random, so that two different words collide
with a probability of about 2 ** -64.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Longer texts are taken in pieces that end at white space.
_PIECE = 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def randoms(count: int, seed: int) -> np.ndarray:
    """The first numbers of a sequence of 64-bit numbers, the same on all machines."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_VALUE = randoms(256, 7)
_VALUE[65:91] = _VALUE[97:123]
_ODD = randoms(64, 11) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, count: int) -> np.ndarray:
    """Powers 0.. of a base, kept for the next text; texts come in pieces, so they are bounded."""
    known = _powers[kind]
    if len(known) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if count <= 2 * _PIECE:  # a longer piece is one word, and rare
            _powers[kind] = known
    return known[:count]


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    white = np.concatenate([[True], _WHITE[data], [True]])
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    moved = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data) + 1)[starts]
    return mixed(moved + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if len(data) <= _PIECE:
        return _piece_hashes(data)
    out, at = [], 0
    while at < len(data):
        stop = min(at + _PIECE, len(data))
        while stop < len(data) and not _WHITE[data[stop]]:
            gap = np.flatnonzero(_WHITE[data[stop : stop + _PIECE]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + _PIECE, len(data))
        out.append(_piece_hashes(data[at:stop]))
        at = stop
    return np.concatenate(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * _ODD[i]
    return mixed(total)
