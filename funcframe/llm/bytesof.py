"""Words of many UTF-8 texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are worked on at a time where that needs many times their memory.
STEP = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of a splitmix generator)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def member(signs: bytes) -> np.ndarray:
    """A table of 256 truths for the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


@dataclass
class Words:
    """``data``: the texts, each followed by a line feed. Word i is data[begin[i]:end[i]] and belongs to text ``doc[i]``."""

    data: np.ndarray
    ends: np.ndarray
    space: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    counts: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def total(self, mask: np.ndarray) -> np.ndarray:
        """For each word, how many of its bytes are in ``mask``."""
        total = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.cumsum(mask, out=total[1:], dtype=np.int32)
        return total[self.end] - total[self.begin]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a sum with a random factor for each place, mixed with the length."""
        if not len(self.begin):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.begin
        upto = np.cumsum(size)
        factor = _factors(0, int(min(size.max(), STEP)))
        total = np.empty(len(size), dtype=np.uint64)
        i = 0
        while i < len(size):  # about STEP bytes at a time; a longer word in pieces
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + STEP, side="right")))
            own = self.data[self.begin[i] : self.end[j - 1]]
            if j == i + 1 and size[i] > STEP:
                held = np.zeros(1, dtype=np.uint64)
                for at in range(0, len(own), STEP):
                    part = own[at : at + STEP]
                    part = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
                    held += (part * _factors(at, at + len(part))).sum(dtype=np.uint64)
                total[i] = held[0]
            else:
                own = own[~self.space[self.begin[i] : self.end[j - 1]]]
                own = _LOWER[own] if lower else own
                first = np.cumsum(size[i:j]) - size[i:j]
                place = np.arange(len(own), dtype=np.int32) - np.repeat(first.astype(np.int32), size[i:j])
                total[i:j] = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * factor[place], first)
            i = j
        return mix64(total ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _factors(a: int, b: int) -> np.ndarray:
    """Random odd factors of the places a to b of a word."""
    return mix64((np.arange(a, b, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(raw: list[bytes | None]) -> Words:
    texts = [t or b"" for t in raw]
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    counts = np.diff(np.searchsorted(begin, ends), prepend=0)
    return Words(data, ends, space, begin, end, counts)
