"""Words, 64-bit word hashes, rolling hashes and minimisers over byte buffers.

Everything works on the UTF-8 bytes of many texts at once (numpy), so no
Python object is made per word.  A word is a maximal run of "word bytes"; the
classes used by the operators only name ASCII separators, so testing bytes is
the same as testing characters.
"""

from __future__ import annotations

import numpy as np

CHUNK = 2 << 20          # bytes of whole texts taken together (a longer text stands alone)
PIECE = 256 << 10        # bytes hashed at a time
GRAM = 16                # words of the anchor grams that minimisers are chosen from
_U = np.uint64

# words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# one random 64-bit value per byte, and the odd bases of the rolling hashes
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_B = 0xD1342543DE82EF95
_B_INV = pow(_B, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray):
    """Starts and ends of all words, and ``first`` with ``first[d]`` the first word of text d."""
    mask = word_byte[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_byte: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, PIECE bytes at a time (a longer word stands alone)."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        part, s = data[starts[i]: ends[j - 1]], starts[i:j] - starts[i]
        longest = int((ends[i:j] - starts[i:j]).max())
        inside = np.arange(len(part), dtype=np.int32 if len(part) < 2**31 else np.int64)
        inside -= np.repeat(s.astype(inside.dtype), np.diff(np.r_[s, len(part)]))
        vals = np.where(word_byte[part], _BYTE[part], _U(0))
        vals *= powers(int(_P), longest)[np.minimum(inside, longest - 1)]
        out[i:j] = np.add.reduceat(vals, s)
        i = j
    return mix(out)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes (mod 2^64) of every run of ``width`` word hashes, over the concatenation."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_B, len(h)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_B_INV, n))


def sliding(v: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) of every run of ``width`` values, by doubling."""
    if len(v) < width:
        return v[:0]
    cur, have = v, 1
    while have * 2 <= width:
        cur = op(cur[:-have], cur[have:])
        have *= 2
    rest = width - have
    return op(cur[:len(cur) - rest], cur[rest:]) if rest else cur


def window_minima(h: np.ndarray, first: np.ndarray, window: int, gram: int = GRAM) -> np.ndarray:
    """For each window of ``window`` words that lies in one text, the smallest hash
    among its ``gram``-word grams (its minimiser), else 0.  One value per word position
    that can start a window of the concatenation."""
    grams = rolling(h, gram)
    low = sliding(grams, window - gram + 1, np.minimum)
    ok = np.zeros(len(low), bool)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= window:
            ok[a: b - window + 1] = True
    return np.where(ok, low, _U(0))


def cover(starts: np.ndarray, width: int) -> np.ndarray:
    """Merge the runs ``[s, s + width)`` of sorted ``starts`` into maximal (start, end) rows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    s = np.unique(starts)
    new = np.r_[True, s[1:] > s[:-1] + width]
    return np.c_[s[new], s[np.r_[new[1:], True]] + width]
