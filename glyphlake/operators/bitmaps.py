"""Compressed bitmaps of the numbers 0 to 65535: lists, bit sets or runs, whichever is smallest.

A bitmap is ``bytes``: one byte for its kind, then little-endian 16-bit numbers
(kind ``l``: the members in order; kind ``r``: first and last member of every
run) or 8,192 bytes of bits (kind ``b``).  The empty bitmap is an empty list.
"""

from __future__ import annotations

import numpy as np

#: Numbers a bitmap may hold, and the bytes of a bit set.
SPAN = 1 << 16
_BITS = SPAN // 8


def pack(members: np.ndarray) -> bytes:
    """The bitmap of distinct members in order."""
    m = members.astype("<u2")
    if not len(m):
        return b"l"
    cuts = np.flatnonzero(np.diff(m.astype(np.int32)) != 1)
    runs = len(cuts) + 1
    if 4 * runs < min(2 * len(m), _BITS):
        ends = np.empty(2 * runs, dtype="<u2")
        ends[0::2], ends[1::2] = m[np.r_[0, cuts + 1]], m[np.r_[cuts, len(m) - 1]]
        return b"r" + ends.tobytes()
    if 2 * len(m) <= _BITS:
        return b"l" + m.tobytes()
    return b"b" + np.packbits(_dense(m), bitorder="little").tobytes()


def _dense(members: np.ndarray) -> np.ndarray:
    out = np.zeros(SPAN, dtype=bool)
    out[members] = True
    return out


def members(bitmap: bytes) -> np.ndarray:
    """The members in order."""
    kind, data = bitmap[:1], bitmap[1:]
    if kind == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")).astype("<u2")
    own = np.frombuffer(data, dtype="<u2")
    if kind == b"l" or not len(own):
        return own
    return np.concatenate([np.arange(a, b + 1) for a, b in zip(own[0::2].tolist(), own[1::2].tolist())]).astype("<u2")


def has(bitmap: bytes, numbers: np.ndarray) -> np.ndarray:
    """Which of some numbers are members."""
    kind, data = bitmap[:1], bitmap[1:]
    if kind == b"b":
        return (np.frombuffer(data, dtype=np.uint8)[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1).astype(bool)
    own = np.frombuffer(data, dtype="<u2")
    if not len(own):
        return np.zeros(len(numbers), dtype=bool)
    if kind == b"l":
        return own[np.minimum(np.searchsorted(own, numbers), len(own) - 1)] == numbers
    at = np.searchsorted(own[0::2], numbers, side="right") - 1
    return (at >= 0) & (numbers <= own[1::2][np.maximum(at, 0)])


def and_not(a: bytes, b: bytes) -> bytes:
    """The members of ``a`` that are none of ``b``."""
    if a[:1] == b[:1] == b"b":
        left = np.frombuffer(a[1:], dtype=np.uint64) & ~np.frombuffer(b[1:], dtype=np.uint64)
        return pack(np.flatnonzero(np.unpackbits(left.view(np.uint8), bitorder="little")))
    own = members(a)
    return pack(own[~has(b, own)])


def union(a: bytes, b: bytes) -> bytes:
    if len(a) == 1 or len(b) == 1:
        return b if len(a) == 1 else a
    return pack(np.union1d(members(a), members(b)))
