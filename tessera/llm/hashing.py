"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Bytes whose powers are kept; longer spans make their own.
_BLOCK_BITS = 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(1 << _BLOCK_BITS)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for every span (in order, apart); equal bytes give equal hashes, wherever they lie.

    Works through the data in blocks of bounded memory; only a single longer span takes more.
    """
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        base = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, base + (1 << _BLOCK_BITS) - 1, side="right")))
        part = data[base : end[j - 1]]
        up, down = _powers() if len(part) < 1 << _BLOCK_BITS else _made_powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        first, after = begin[i:j] - base, end[i:j] - base
        raw = (total[after] - total[first]) * down[first]
        out[i:j] = mixed(raw ^ ((after - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        i = j
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a line feed after each, and where each ends (its feed included)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), ends


def words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of anything but ASCII white space), and each text's words end."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, ends = joined(texts)
    if lower:
        data = _LOWER[data]
    inner = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner]).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return span_hashes(data, begin, end), np.searchsorted(begin, ends)


#: Classes of bytes whose runs are tokens: space, letters (all beyond ASCII too), digits, others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[_SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters, of digits and of other signs, case kept; each text's tokens end."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, ends = joined(texts)
    kind = _CLASS[data]
    change = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(data)]])
    begin, end = change[:-1], change[1:]
    inner = kind[begin] != 0
    begin, end = begin[inner], end[inner]
    return span_hashes(data, begin, end), np.searchsorted(begin, ends)
