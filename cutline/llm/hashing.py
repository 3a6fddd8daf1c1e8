"""Vectorised 64-bit hashes in numpy, the same on every machine."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_U = np.uint64
#: Bytes of a span up to which it is hashed eight bytes at a time for all spans at once.
STEPPED = 256
#: Modulus and base of the sums over runs of bytes: a Mersenne prime, and an odd number below it.
PRIME, BASE = (1 << 61) - 1, 0x1E3779B97F4A7C15 % ((1 << 61) - 1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(_U) + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUES = mixed(np.arange(256, dtype=_U), 77)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] (bytes) for each span: eight bytes are joined to the state and mixed at a time, so no sum of bytes can cancel out.

    Spans of more than STEPPED bytes, which are few, take BLAKE2b.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = ends - starts
    out, at, live = mixed(left.astype(_U), 40), np.asarray(starts), np.flatnonzero((left > 0) & (left <= STEPPED))
    done = 0
    while len(live):
        taken = np.minimum(left[live] - done, 8)
        out[live] = mixed(out[live] ^ mixed(eights[at[live] + done] & _MASKS[taken], 41), 42)
        done += 8
        live = live[left[live] > done]
    for i in np.flatnonzero(left > STEPPED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below it, by halves of 31 bits."""
    low = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & low, b >> _U(31), b & low
    middle = a1 * b0 + a0 * b1
    total = _U(2) * a1 * b1 + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + a0 * b0
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 and its inverses, modulo PRIME; n is a power of two."""

    def run(base: int) -> np.ndarray:
        out, k = np.ones(1, _U), 1
        while k < n:
            out, k = np.concatenate([out, _times(out, np.full(k, pow(base, k, PRIME), _U))]), 2 * k
        return out

    return run(BASE), run(pow(BASE, -1, PRIME))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash below PRIME of data[start:end] (bytes) for each of many overlapping spans, whatever its place: differences of running sums modulo a prime."""
    up, down = _powers(1 << max(16, int(len(data) + 1).bit_length()))
    value = data.astype(_U) + _U(1)
    sums = []
    for part in (up[: len(data)] >> _U(31), up[: len(data)] & _U((1 << 31) - 1)):
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(part * value, dtype=_U, out=total[1:])  # wraps; a difference over a span of STRIDE bytes at most does not
        sums.append(total)
    high, low = (np.zeros(len(starts), _U) for _ in range(2))
    begin = np.asarray(starts)
    while (begin < ends).any():
        stop = np.minimum(begin + STRIDE, ends)
        high, low = (_reduced(acc + _reduced(s[stop] - s[begin])) for acc, s in zip((high, low), sums, strict=True))
        begin = stop
    whole = _reduced(_times(high, np.full(len(high), 1 << 31, _U)) + low)
    return _times(whole, down[np.asarray(starts)])


#: Bytes of a span whose parts of a sum stay below 2**64.
STRIDE = 1 << 23
