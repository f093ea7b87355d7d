"""Byte windows of words: the coding contexts of the byte models of this subpackage.

A word is coded byte by byte and closed by a blank; the context of a byte is what precedes it in the word, after a blank
that marks the start. What a model charges for a byte then depends on a window of a few bytes, so each distinct word, and
each distinct window, is scored once however often it occurs.
"""

from __future__ import annotations

import numpy as np

BLANK = 32


def windows(distinct: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each coded byte of each word, and where each word's windows start.

    A window is an integer: its context's length (1 to depth, at most 6) in the top byte, then the context's bytes from
    the farthest to the nearest (0 where there is none), then the byte coded.
    """
    raw = np.frombuffer(b" " + b" ".join(distinct) + b" ", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    starts = np.cumsum(size + 1) - (size + 1)
    # Position p of `raw` from 1 on is coded; how many bytes back its word's blank lies:
    back = np.arange(len(raw) - 1) - np.repeat(starts, size + 1) + 1
    length = np.minimum(back, depth).astype(np.uint64)
    out = raw[1:].copy()
    for d in range(1, depth + 1):
        far = raw[:-d] if d > 1 else raw[:-1]
        part = np.zeros(len(out), np.uint64)
        part[d - 1 :] = far
        part[length < d] = 0
        out |= part << np.uint64(8 * d)
    return out | (length << np.uint64(56)), starts


class WordIds(dict):
    """word -> running number; new words are listed in `fresh`."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at
