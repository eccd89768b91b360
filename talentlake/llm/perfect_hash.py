"""A minimal perfect hash over 64-bit keys: bit arrays by level, with ranks.

A level sends each key to a bit; keys alone on their bit stay, the others go to the next level. The rank of a key's bit
among all set bits is its number, so ``n`` keys get the numbers 0 to n - 1. A key that was not inserted gets some number or
none; whoever uses the numbers must compare a fingerprint.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .text_hash import mix

SPARE = 2  # bits of a level per key that enters it
LEVELS = 48
STEP = 0x9E3779B97F4A7C15


@dataclass
class PerfectHash:
    words: np.ndarray  # the bits of all levels, 64 to a word
    ranks: np.ndarray  # set bits before each word
    starts: np.ndarray  # first word of each level, and the end

    @staticmethod
    def place(keys: np.ndarray, level: int, n_words: int) -> np.ndarray:
        return mix(keys + np.uint64((level + 1) * STEP % 2**64)) % np.uint64(64 * n_words)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash of distinct keys, and which keys it could not place (equal ones after all levels)."""
        levels, starts, left = [], [0], np.arange(len(keys))
        for level in range(LEVELS):
            if not len(left):
                break
            n_words = -(-SPARE * len(left) // 64)
            at = cls.place(keys[left], level, n_words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            starts.append(starts[-1] + n_words)
            left = left[~alone[at]]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        ranks = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=ranks[1:])
        return cls(words, ranks, np.array(starts)), left

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 where no level has a bit for it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            if not len(left):
                break
            n_words = int(self.starts[level + 1] - self.starts[level])
            at = self.place(keys[left], level, n_words)
            word, bit = self.starts[level] + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            found = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (self.ranks[word] + np.bitwise_count(below))[found]
            left = left[~found]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.starts), len(self.words)], "<i8").tobytes() + self.starts.astype("<i8").tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n_starts, n_words = np.frombuffer(data, "<i8", 2)
        starts = np.frombuffer(data, "<i8", n_starts, 16)
        words = np.frombuffer(data, "<u8", n_words, 16 + 8 * n_starts)
        ranks = np.zeros(n_words + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=ranks[1:])
        return cls(words, ranks, starts)
