"""Word shingles and MinHash signatures of whole texts, vectorised over many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
GROUP = 1 << 20
#: Words of more bytes are digested one by one: a polynomial over them could give different ones equal values.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class _Tables:
    down = _powers(_INV, 1)
    up = _powers(_P, 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Tables.down) < n:
        if n > 4 * GROUP:  # one very long text: not kept
            return _powers(_INV, n), _powers(_P, n)
        _Tables.down, _Tables.up = _powers(_INV, n), _powers(_P, n)
    return _Tables.down, _Tables.up


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of distinct k-word shingles as 64-bit hashes, each sorted, and where each set begins (one more entry at the end).

    Words are runs without white space, A-Z lower-cased; a text of fewer than k words has its whole
    sequence as its one shingle, a text without words has none.
    """
    sets: list[np.ndarray] = []
    sizes: list[int] = []
    group: list[bytes] = []
    n = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        group.append(b)
        n += len(b) + 1
        if n >= GROUP or i + 1 == len(texts):
            _group(group, k, sets, sizes)
            group, n = [], 0
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), starts


def _group(group: list[bytes], k: int, sets: list[np.ndarray], sizes: list[int]) -> None:
    raw = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    first, last = edge[::2], edge[1::2]  # words are raw[first:last]
    down, up = _tables(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=prefix[1:])
    words = _mix((prefix[last] - prefix[first]) * up[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(last - first > LONG_WORD).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    ends = np.cumsum([len(b) + 1 for b in group])
    of = np.searchsorted(first, ends)  # words before each text's end
    at = 0
    for e in of.tolist():
        w = words[at:e]
        at = e
        if not len(w):
            sizes.append(0)
            continue
        m = min(k, len(w))
        h = w[: len(w) - m + 1]
        for j in range(1, m):
            h = _mix(h * np.uint64(0x9FB21C651E98DF25) + w[j : len(w) - m + 1 + j])
        h = np.sort(_mix(h + np.uint64(m)))
        keep = np.empty(len(h), bool)
        keep[0] = True
        np.not_equal(h[1:], h[:-1], out=keep[1:])
        h = h[keep]
        sets.append(h)
        sizes.append(len(h))


def minhashes(values: np.ndarray, starts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` 16-bit minhash values of each nonempty set (rows in order; zero rows for empty sets)."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1 << 31, 1 << 32, count, np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, count, np.uint32)
    n = len(starts) - 1
    out = np.zeros((n, count), np.uint16)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    # by groups of sets that stay in cache
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(starts[full + 1], starts[full[lo]] + (1 << 16), "right")))
        part = full[lo:hi]
        a, b = starts[part[0]], starts[part[-1] + 1]
        x = (values[a:b] >> np.uint64(32)).astype(np.uint32)
        x2 = values[a:b].astype(np.uint32)
        cuts = starts[part] - a
        for i in range(count):
            y = (x ^ add[i]) * mult[i]
            y += x2
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(12)
            out[part, i] = np.minimum.reduceat(y, cuts).astype(np.uint16)
        lo = hi
    return out


def set_digests(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set, as signed numbers."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        mixed = _mix(_mix(values ^ np.uint64(seed)) + np.uint64(seed))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        out.append(_mix((sums[starts[1:]] - sums[starts[:-1]]) ^ np.diff(starts).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of two sorted sets' intersection."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
