"""Words of many texts as numpy arrays of 64-bit hashes.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``.  A word's hash chains its length and its bytes, eight at a
time, through a mixing bijection, all words of a block at once; words of more than LANES times eight bytes go through a
cryptographic hash.  So no arrangement of bytes collides by its structure, as it would in a polynomial modulo 2**64, and equal
words have equal hashes everywhere.  Blocks hold about BLOCK bytes, and a longer text is cut between words, so memory does not
grow with a text.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

BLOCK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> _S)
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


@functools.lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base % (1 << 64), dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


#: Steps of eight bytes that are taken side by side for all words.
LANES = 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    sep = _SEPARATES[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw + bytes(16), strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    h = mix(n.astype(np.uint64) * _STEP)
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(n, 8)]))
    for k in range(1, LANES):
        more = np.flatnonzero(n > 8 * k)
        if not len(more):
            return h
        h[more] = mix(h[more] * _STEP ^ (eight[starts[more] + 8 * k] & _MASK[np.minimum(n[more] - 8 * k, 8)]))
    for r in np.flatnonzero(n > 8 * LANES).tolist():
        h[r] = int.from_bytes(hashlib.blake2b(raw[starts[r] : ends[r]], digest_size=8).digest(), "little")
    return h


def _pieces(raw: bytes):
    """A long text in pieces that end at separators."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and not _SEPARATES[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def words_of(raw: bytes) -> np.ndarray:
    """The word hashes of one text of any length."""
    if len(raw) <= 2 * BLOCK:
        return hashes(raw, *spans(raw))
    return np.concatenate([hashes(p, *spans(p)) for p in _pieces(raw)])


def blocks(texts: list[bytes]):
    """(first row, rows, word hashes, where each row's words start and the last end) for runs of texts."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < BLOCK:
            size += len(texts[end])
            end += 1
        if end == at + 1:
            w = words_of(texts[at])
            yield at, 1, w, np.array([0, len(w)])
        else:
            raw = b" ".join(texts[at:end])
            s, e = spans(raw)
            offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[at:end]])))
            yield at, end - at, hashes(raw, s, e), np.searchsorted(s, offsets)
        at = end


def rolled(w: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of each run of k neighbours, not mixed; empty where there are fewer."""
    n = len(w)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    if k <= 8:
        out = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            out *= np.uint64(base)
            out += w[j : n - k + 1 + j]
        return out
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(w * powers(base, _room(n))[:n], out=sums[1:])
    return (sums[k:] - sums[:-k]) * powers(pow(base, -1, 1 << 64), _room(n))[: n - k + 1]


def shingle_rows(w: np.ndarray, at: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93):
    """(mixed hashes of each row's k-word shingles one row after the other, where each row's start and the last end).

    A row with fewer words has one shingle of them all, one without words has none.
    """
    count = np.diff(at)
    every = mix(rolled(w, k, base))
    many = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if not len(short) and len(count) == 1:
        return every, np.array([0, len(every)])
    out_at = np.concatenate(([0], np.cumsum(np.where((count > 0) & (count < k), 1, many))))
    first = np.repeat(at[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out = np.empty(int(out_at[-1]), dtype=np.uint64)
    place = np.repeat(out_at[:-1], many) + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    out[place] = every[first] if len(first) else 0
    for r in short.tolist():
        run = w[at[r] : at[r + 1]]
        out[out_at[r]] = mix(rolled(run, len(run), base) + np.uint64(len(run)))[0]
    return out, out_at
