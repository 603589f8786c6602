"""64-bit hashes of the words of whole texts, vectorised over their UTF-8 bytes."""

from __future__ import annotations

import re

import numpy as np

_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """Words are the longest runs of bytes outside of ``gaps``."""

    def __init__(self, gaps: bytes) -> None:
        self._is_gap = np.zeros(256, dtype=bool)
        self._is_gap[list(gaps)] = True
        self._gap = re.compile(b"[" + b"".join(b"\\x%02x" % g for g in gaps) + b"]")

    def _of_piece(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes by differences of one running polynomial sum."""
        gap = self._is_gap[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        up, down = _POWERS.upto(len(raw))
        running = np.cumsum(np.where(gap, np.uint64(0), _BYTE[raw]) * up, dtype=np.uint64)
        before = np.where(start > 0, running[start - 1], np.uint64(0))
        return mix((running[end - 1] - before) * down[start] + (end - start).astype(np.uint64) * _STEP), start, end

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of every word; ``raw`` is read in pieces that end at gaps."""
        parts, k = [], 0
        while k < len(raw):
            cut = self._gap.search(raw, k + _PIECE)
            stop = cut.start() if cut else len(raw)
            value, start, end = self._of_piece(np.frombuffer(raw, np.uint8, stop - k, k))
            parts.append((value, start + k, end + k))
            k = stop
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` consecutive words from each position on; none if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] + np.uint64(width)
    for i in range(1, width):
        out = out * _BASE + words[i : i + n]
    return mix(out)
