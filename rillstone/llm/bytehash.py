"""Vectorised hashing of byte ranges: prefix sums of a polynomial modulo the prime 2**61 - 1.

Equal bytes have equal hashes. The reverse holds only with high chance, so hashes choose what is
compared; ``exact_ids`` and ``word_digests`` decide by the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
PRIME = (1 << 61) - 1
_P = _U(PRIME)
_BASE = 0x1A2F6B3C5D7E8F91 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_powers: dict[str, np.ndarray] = {}
#: Elements that are multiplied at a time, so that all intermediates stay in cache.
_STRIP = 1 << 14
#: Elements whose byte terms are summed before they are reduced: 39 + 14 bits fit, and so do
#: the two halves and the sum of the blocks before.
_BLOCK = 1 << 14


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**64."""
    x = (x & _P) + (x >> _U(61))
    return np.minimum(x, x - _P)  # below zero it wraps to the large side


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of two arrays of residues, modulo the prime."""
    out = np.empty(len(a), _U)
    half, low = _U(31), _U((1 << 31) - 1)
    for at in range(0, len(a), _STRIP):
        x, y = a[at : at + _STRIP], b[at : at + _STRIP]
        xh, xl, yh, yl = x >> half, x & low, y >> half, y & low
        middle = xl * yh + xh * yl
        total = ((xh * yh) << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << half) + xl * yl
        out[at : at + _STRIP] = _fold(total)
    return out


def _power(base: int, n: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; kept for the largest n seen, doubled when short."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.ones(1, _U)
        while len(out) < n:
            out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), PRIME), _U))])
        _powers[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all bits of its input."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RangeHash:
    """Hashes of any byte ranges of one array; equal bytes have equal hashes."""

    def __init__(self, data: np.ndarray):
        self.n = n = len(data)
        self.sums = np.zeros(n + 1, _U)
        power, carry = _power(_BASE, n, "up"), _U(0)
        for at in range(0, n, _BLOCK):
            part = data[at : at + _BLOCK].astype(_U) + _U(1)
            up = power[at : at + _BLOCK]
            # halves of a power by a byte have 39 bits, so a block's sums of them stay exact
            high = np.cumsum(part * (up >> _U(31)))
            low = np.cumsum(part * (up & _U((1 << 31) - 1)))
            high = ((high & _U((1 << 30) - 1)) << _U(31)) + (high >> _U(30))
            block = _fold(high + low + carry)
            self.sums[at + 1 : at + 1 + len(part)] = block
            carry = block[-1]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = times(_fold(self.sums[end] + _P - self.sums[start]), _power(_INVERSE, self.n + 1, "down")[start])
        return mix(raw + ((end - start).astype(_U) << _U(40)))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the ``k`` bytes from each position that has them."""
        if self.n < k:
            return np.zeros(0, _U)
        raw = _fold(self.sums[k:] + _P - self.sums[:-k])
        return mix(times(raw, _power(_INVERSE, self.n + 1, "down")[: len(raw)]) + (_U(k) << _U(40)))


def by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` (small whole numbers) by row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; none crosses a row's boundary."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    end = np.flatnonzero(inside & (~after | cut[1 : n + 1])) + 1
    return start, end


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, strip: int = 1 << 20) -> bool:
    """Whether all pairs of ranges (from a and b, of the given sizes) hold the same bytes."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, done + strip, "right")))
        if to == at + 1:  # one range, however long, needs no index
            if not np.array_equal(data[a[at] : a[at] + size[at]], data[b[at] : b[at] + size[at]]):
                return False
        else:
            n = size[at:to]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if not np.array_equal(data[np.repeat(a[at:to], n) + step], data[np.repeat(b[at:to], n) + step]):
                return False
        at = to
    return True


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of byte ranges, equal if and only if the bytes are, and the first range of each id.

    Ranges are put together by their hashes and each is compared with the first of its hash;
    should one differ, all ids come from the bytes themselves.
    """
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size, of = end - start, first[ids]
    later = np.flatnonzero(of != np.arange(len(of)))
    if (size[later] == size[of[later]]).all() and _same_bytes(data, start[later], start[of[later]], size[later]):
        return ids, first
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return ids, np.unique(ids, return_index=True)[1]


def word_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b of each byte range; each different one is digested once."""
    ids, first = exact_ids(data, start, end, hashes)
    raw = data.tobytes()
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
    return np.frombuffer(digests, np.uint64)[ids]
