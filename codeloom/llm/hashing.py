"""Word and window hashes of whole batches, in numpy.

Words are runs of anything but the six ASCII blanks; such bytes never occur inside a UTF-8
character, so the work is done on bytes. The distinct words of a batch are told apart by their
bytes, and each is hashed once, by 128 bits of XXH3. k words in a row hash to a polynomial of their
hashes modulo the prime 2**61 - 1. Modulo a power of two, certain sequences (those of Thue and Morse)
would meet under every odd base; modulo a prime, two sequences of n words meet under n of its bases at most.
There are two bases, each with its own half of the words' hashes. Polynomials come from running
sums, so a batch costs a few passes whatever the width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
#: Two bases, for hashes of the same words that are independent of each other.
FIRST, OTHER = 0x9E3779B97F4A7C15 % PRIME, 0xC2B2AE3D27D4EB4F % PRIME


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, from products of halves of 32 bits."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    middle, least = ah * bl + al * bh, al * bl
    return _reduced(ah * bh * np.uint64(8) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half) + (least >> np.uint64(61)) + (least & _P))


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of x[:i] modulo the prime; halves of 31 bits can't overflow."""
    half = np.uint64(31)
    high, low = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]) for v in (x >> half, x & np.uint64((1 << 31) - 1)))
    return _reduced(times(_reduced(high), np.uint64(1 << 31)) + _reduced(low))


#: Powers of a base, up to the longest that was asked for so far, within KEPT.
_KNOWN: dict[int, np.ndarray] = {}
KEPT = 2 << 20


def _powers(base: int, n: int) -> np.ndarray:
    known = _KNOWN.get(base)
    if known is None or len(known) < n:
        wanted = n + n // 4 if n < KEPT else n
        known = np.ones(1, np.uint64)
        while len(known) < wanted:
            known = np.concatenate([known, times(known, np.uint64(pow(base, len(known), PRIME)))])
        if n < KEPT:
            _KNOWN[base] = known
    return known[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, PRIME)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte of each word of texts laid end to end, and the first word of each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of words that are told apart at once; bounds the memory that one long text takes.
STRETCH = 8 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent values below the prime for each word (rows)."""
    out = np.empty((2, len(starts)), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + STRETCH, side="right")))
        first, sizes = int(starts[low]), ends[low:high] - starts[low:high]
        own = data[first : ends[high - 1]]
        inside = ~BLANK[own]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        listed = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(own[inside]))]).dictionary_encode()
        told = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, listed.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
        out[:, low:high] = _reduced(told).T[:, listed.indices.to_numpy(zero_copy_only=False)]
        low = high
    return out


def _half(hashes: np.ndarray, base: int) -> np.ndarray:
    return hashes[0 if base == FIRST else 1]


def window_hashes(hashes: np.ndarray, width: int, base: int = FIRST) -> np.ndarray:
    """Hash of the words i : i + width at each i where that many are left."""
    n = hashes.shape[1]
    if n < width:
        return np.zeros(0, np.uint64)
    sums = _running(times(_half(hashes, base), _powers(base, n)))
    return mix(times(_reduced(sums[width:] + (_P - sums[: n - width + 1])), _powers(_inverse(base), n)[: n - width + 1]))


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = FIRST) -> np.ndarray:
    """Hash of the words s : e for ranges of any lengths; equal ranges have equal hashes."""
    n = hashes.shape[1]
    sums = _running(times(_half(hashes, base), _powers(base, n)))
    return mix(times(_reduced(sums[ends] + (_P - sums[starts])), _powers(_inverse(base), n + 1)[starts]) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick.reduce(values[i : i + width]) at each i, by doubling."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def fits(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n words start a window of ``width`` inside their own text. first: texts' first words and the end."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= width
