"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below ``n`` or more."""
    return _powers(max(20, int(n - 1).bit_length()))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over ``data[:i] + 1`` times base**i; with them, any slice's hash takes two look-ups."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (bytes between ASCII white space) and the index of its text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return slice_hashes(prefix_sums(data), start, end), np.searchsorted(ends, start, side="right")


def shingles(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each text's distinct k-word shingles, sorted; a text with fewer words is one shingle, one without words none."""
    h, doc = words(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    c = np.uint64(1)
    for i in range(k):
        if len(out):
            out += h[i : i + len(out)] * c
        c = np.uint64(int(c) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    inside = doc[: len(out)] == doc[k - 1 :] if len(out) else np.zeros(0, bool)
    docs, hashes = doc[: len(out)][inside], mix(out[inside])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = []
        for t in short.tolist():
            c = 1
            total = 0
            for x in h[first[t] : first[t] + n[t]].tolist():
                total, c = (total + x * c) % (1 << 64), c * 0xC2B2AE3D27D4EB4F % (1 << 64)
            whole.append(total ^ int(n[t]))
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, mix(np.array(whole, np.uint64))])
    signed = hashes.view(np.int64)
    order = np.lexsort((signed, docs))
    docs, signed = docs[order], signed[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (signed[1:] != signed[:-1])
    return docs[new], signed[new]
