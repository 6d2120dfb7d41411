"""Word shingles, their min-hash signatures and segment counts, as vectorised numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .common import WORD, hash64, mix

_A = np.uint64(0x9E3779B97F4A7C15)


class Signer:
    """Signatures of texts: `bands` keys of `rows` min-hashes each over `width`-word shingles, and `segments` counts of shingles."""

    def __init__(self, width: int, bands: int, rows: int, segments: int = 0):
        self.width, self.bands, self.rows, self.segments = width, bands, rows, segments
        rng = np.random.default_rng(20)
        self.mult = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.seen: dict[str, int] = {}

    def sets(self, texts: list[str | None], least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which texts have at least `least` words; the distinct shingle hashes of these, one text behind the other; where each begins."""
        return self.sets_of((WORD.findall(t.lower()) if t else [] for t in texts), least)

    def sets_of(self, texts: Iterable[list[str]], least: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The same of texts that are lists of words."""
        words: list[str] = []
        at, starts = [], []
        for i, ws in enumerate(texts):
            if len(ws) >= max(least, self.width):
                at.append(i)
                starts.append(len(words))
                words += ws
        if not at:
            return [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = hash64(words, self.seen)
        n = len(h)
        s = h[: n - self.width + 1].copy()
        for k in range(1, self.width):
            s = mix(s * _A + h[k : n - self.width + 1 + k])
        doc = np.repeat(np.arange(len(at)), np.diff([*starts, n]))
        ends = np.array([*starts[1:], n])
        ok = np.arange(len(s)) + self.width <= ends[doc[: len(s)]]
        s, doc = s[ok], doc[: len(ok)][ok]
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
        return at, s, np.searchsorted(doc, np.arange(len(at)))

    def keys(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band keys, a row of `bands` for each text."""
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        out = np.empty((len(starts), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(starts), b, np.uint64)
            for r in range(b * self.rows, (b + 1) * self.rows):
                y = x * self.mult[r] + self.add[r]
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x2C1B3C6D)
                y ^= y >> np.uint32(12)
                key = mix(key * _A + np.minimum.reduceat(y, starts).astype(np.uint64))
            out[:, b] = key
        return out.view(np.int64)

    def counts(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many shingles of each text fall into each segment of the hash space."""
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(s)]))
        flat = np.bincount(of * self.segments + (s % np.uint64(self.segments)).astype(np.int64), minlength=len(starts) * self.segments)
        return flat.reshape(len(starts), self.segments)
