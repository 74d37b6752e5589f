"""Hashes of the words of texts, for whole batches at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed together in groups of about this many bytes; a longer text is cut at white space.
GROUP_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * GROUP_BYTES)
        for k, base in ((0, _ODD), (1, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _hash_block(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def hash_words(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of ``blob``, in order; a word is a run without white space (bytes 9 to 13 and 32).

    Bytes are summed as digits of a polynomial modulo 2^64, so a word's hash doesn't depend on where it stands.
    """
    raw = np.frombuffer(blob, np.uint8)
    if len(raw) <= 2 * GROUP_BYTES:
        return _hash_block(raw)
    parts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + GROUP_BYTES)
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        h, s, e = _hash_block(raw[at:to])
        parts.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about GROUP_BYTES each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text in order: (hashes, starts, ends) of its words, offsets counted in bytes from its own start."""
    for a, b in grouped(texts):
        h, s, e = hash_words(b"\n".join(texts[a:b]))
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        cut = np.searchsorted(s, begin)
        for k in range(b - a):
            i, j = cut[k], cut[k + 1]
            yield h[i:j], s[i:j] - begin[k], e[i:j] - begin[k]


_SLOT = np.random.default_rng(577215664).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` consecutive words (none if there are fewer); sensitive to order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 16:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += words[k : k + n] * _SLOT[k]
        return mixed(out)
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[:n])


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-word shingles; a shorter text is one shingle, no words give none."""
    if 0 < len(words) < size:
        own = np.zeros(1, np.uint64)
        for k in range(len(words)):
            own += words[k : k + 1] * _SLOT[k + 32]
        return mixed(own + np.uint64(len(words)))
    return np.unique(window_hashes(words, size))
