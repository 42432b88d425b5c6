"""Counts of hashed character trigrams of whole texts."""

from __future__ import annotations

import unicodedata

import numpy as np

_SLICE = 1 << 20
_PLANE = 1 << 16


def _table(letters_only: bool) -> np.ndarray:
    """Code point to itself, or to a blank where it is white space (or, if letters_only, no letter)."""
    t = np.arange(_PLANE, dtype=np.uint32)
    for c in range(_PLANE):
        if letters_only and unicodedata.category(chr(c))[0] != "L" or chr(c).isspace():
            t[c] = 32
    return t


class Trigrams:
    def __init__(self, buckets: int, letters_only: bool):
        self.buckets, self.table = buckets, _table(letters_only)

    def counts(self, text: str) -> np.ndarray:
        """How often each bucket occurs, blanks around the text included; a slice of the text at a time."""
        total = np.zeros(self.buckets, np.int64)
        before = np.array([32, 32], np.uint32)
        for at in range(0, len(text), _SLICE):
            part = text[at : at + _SLICE].lower()
            c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            c = np.concatenate([before, np.where(c < _PLANE, self.table[np.minimum(c, _PLANE - 1)], c)])
            before = c[-2:]
            h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15)
            blank = (c[1:-1] == 32) & (c[2:] == 32)
            total += np.bincount((h % np.uint32(self.buckets))[~blank], minlength=self.buckets)
        return total
