"""Vectorised words of many texts at once: 64-bit word hashes, five-word shingles and their counts."""

from __future__ import annotations

import numpy as np

from .common import CACHES

P1, P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_VALUE = _FOLD.astype(np.uint64) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
CACHES.append(_POWERS)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[starts[i]:ends[i]], independent of where a run stands."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * inverse[starts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ASCII letters and digits, A-Z folded, and bytes above 127), and the
    upto[i]:upto[i + 1] that are text i's."""
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    is_word = np.zeros(len(data) + 2, np.int8)
    is_word[1:-1] = _WORD[_FOLD[data]]
    edges = np.flatnonzero(np.diff(is_word))
    starts, ends = edges[::2], edges[1::2]
    hashes = mix(_runs(_VALUE[data], starts, ends, P1) + (ends - starts).astype(np.uint64) * np.uint64(P2))
    return hashes, np.append(np.searchsorted(starts, begin), len(starts))


def sequence_hashes(words: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    one = mix(_runs(words, upto[:-1], upto[1:], P1 * 3 & (1 << 64) - 1 | 1))
    two = mix(_runs(mix(words + np.uint64(P2)), upto[:-1], upto[1:], P2))
    return one.view(np.int64), two.view(np.int64)


def shingles(words: np.ndarray, upto: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrence): every run of ``width`` words by its hash, sorted within texts, with
    its number among equal ones of the text from 0. A text of fewer words, but one at least, has one
    shingle of all of them."""
    n = np.diff(upto)
    m = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), m)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m) + upto[:-1][owner]
    end = upto[1:][owner]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        word = padded[at + j]
        word[at + j >= end] = 0
        total = (total + word) * np.uint64(P1) + np.uint64(j)
    hashes = mix(total)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    occurrence = np.arange(len(owner)) - first[np.cumsum(new) - 1] if len(owner) else np.zeros(0, np.int64)
    return owner, hashes, occurrence


def slices(texts: list[str | None], size: int = 1 << 20):
    """(first, list of UTF-8 texts) of about size bytes each; null counts as empty."""
    batch, held, first = [], 0, 0
    for i, t in enumerate(texts):
        batch.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(batch[-1]) + 1
        if held >= size:
            yield first, batch
            batch, held, first = [], 0, i + 1
    if batch:
        yield first, batch
