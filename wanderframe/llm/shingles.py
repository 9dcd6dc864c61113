"""Documents as sets of word shingles, in numpy: 64-bit hashes, fingerprints, ordered prefixes, fixed-size subsets."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np

WORDS = 5
#: Similarity from which on two sets link: LINK_NUM / LINK_DEN of the union.
LINK_NUM, LINK_DEN = 4, 5
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: Frequency classes are kept by the upper bits of a shingle's hash, and are below MOST_CLASSES.
CLASS_BITS, MOST_CLASSES = 22, 16
#: A set posts so many elements more at most than it must, by which sets that link share so many lists more.
MOST_SPARE, SPARE_EACH = 7, 16

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD1B54A32D192ED03)
_byte_code = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


_up, _down = _powers(_BASE, 1 << 14), _powers(_UNBASE, 1 << 14)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each word: a polynomial in its bytes, taken from running sums over the joined words."""
    global _up, _down
    data = np.frombuffer(b" ".join(words), np.uint8)
    if len(data) > len(_up):
        size = 1 << int(len(data) - 1).bit_length()
        _up, _down = _powers(_BASE, size), _powers(_UNBASE, size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_code[data] * _up[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    return _mixed((sums[ends] - sums[starts]) * _down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text (A-Z lower-cased, words between ASCII white space).

    Fewer than five words are one shingle; no words, none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts, block, size = [], [], 0
    for w in words if len(text) > BLOCK else ():
        if block and size + len(w) > BLOCK:
            parts.append(_word_hashes(block))
            block, size = [], 0
        block.append(w)
        size += len(w) + 1
    parts.append(_word_hashes(block or words))
    h = np.concatenate(parts) if len(parts) > 1 else parts[0]
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _STEP + h[i : i + n]
    return np.unique(_mixed(out + U(k)))


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes that equal sets share."""
    ranks = np.arange(1, len(s) + 1, dtype=np.uint64)
    sums = [_mixed((s ^ U(salt)) + ranks * _STEP).sum(dtype=np.uint64) + U(len(s)) for salt in (0, 0x5851F42D4C957F2D)]
    return tuple(int(x) for x in _mixed(np.array(sums, np.uint64)).view(np.int64))


def least_overlap(a: int, b: int) -> int:
    """Elements that sets of these sizes must share to link: inter * DEN >= NUM * (a + b - inter)."""
    return -(-LINK_NUM * (a + b) // (LINK_NUM + LINK_DEN))


def may_link(a: int, b: int) -> bool:
    return LINK_DEN * min(a, b) >= LINK_NUM * max(a, b)


def prefix_length(n: int) -> int:
    """So many elements, first in an order that all sets share, hold a common element of any two that link."""
    return n - -(-LINK_NUM * n // LINK_DEN) + 1


def partner_sizes(n: int) -> range:
    return range(-(-LINK_NUM * n // LINK_DEN), LINK_DEN * n // LINK_NUM + 1)


def subset_count(n: int) -> int:
    return sum(comb(n, least_overlap(n, m)) for m in partner_sizes(n))


def short_length(n):
    """So many, first in that order, of the lesser set of a pair hold the first common element; the greater set's is
    among its first prefix_length. n: a size or an array of sizes."""
    return n - -(-2 * LINK_NUM * n // (LINK_NUM + LINK_DEN)) + 1


def spare(n):
    """How many elements more a set posts. Two sets that link, of sizes m <= n, share 1 + spare(m) lists: of the first
    common elements that many are among the first short_length(m) + spare(m) and prefix_length(n) + spare(n)."""
    return np.minimum(MOST_SPARE, n // SPARE_EACH)


def least_lists(n):
    """So many lists a set of this size shares with any set that it links with: 1 + spare of the least partner's size."""
    return 1 + spare(-(-LINK_NUM * n // LINK_DEN))


def prefix(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first prefix_length + spare elements in the order that all sets share, rarest first: by frequency class, then
    by hash. As ascending non-negative 64-bit keys."""
    p = min(len(s), prefix_length(len(s)) + int(spare(len(s))))
    keys = ((classes[s >> U(64 - CLASS_BITS)].astype(np.uint64) << U(59)) | (s >> U(5))).view(np.int64)
    return np.sort(np.partition(keys, p - 1)[:p] if p < len(s) else keys)


def subset_keys(s: np.ndarray, boundary: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Keys of 128 bits, as two signed longs, of the fixed-size subsets by which a small set meets partners up to the
    boundary: of its own size, and of other sizes.

    A partner's size fixes how many elements must be shared, and the key holds both sizes and the subset. Two sets
    of one size link exactly if they share a key of the first kind; two of different sizes, exactly if they share one
    of the second.
    """
    out: tuple[list[tuple[int, int]], list[tuple[int, int]]] = [], []
    n, elements, mask = len(s), [int(x) for x in s], 0xFFFFFFFFFFFFFFFF
    for m in partner_sizes(n):
        if m <= boundary:
            tag = (min(n, m) * 1_000_003 + max(n, m)) * 0x9E3779B97F4A7C15
            for c in combinations(elements, least_overlap(n, m)):
                h, g = tag, tag ^ 0x2545F4914F6CDD1D
                for x in c:
                    h = ((h ^ x) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & mask
                    h ^= h >> 31
                    g = ((g + x) * 0xBF58476D1CE4E5B9 ^ 0x94D049BB133111EB) & mask
                    g ^= g >> 29
                out[m != n].append(tuple(v - (1 << 64) if v >> 63 else v for v in (h, g)))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def links(a: np.ndarray, b: np.ndarray) -> bool:
    i = overlap(a, b)
    return i > 0 and LINK_DEN * i >= LINK_NUM * (len(a) + len(b) - i)
