"""Hashes of the words of whole texts, many at once."""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, a polynomial of its bytes, and their number; one byte follows each word, at ``ends``."""
    if not len(ends):
        return np.zeros(0, np.uint64), ends
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    size = ends - starts
    powers = np.full(int(size.max()) + 1, STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = raw.astype(np.uint64)
    values[ends] = 0
    values *= powers[np.arange(len(raw)) - np.repeat(starts, size + 1)]
    return mixed(np.add.reduceat(values, starts) + size.astype(np.uint64)), size


def line_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of all lines in order, its bytes, and how many words each line has.

    No line is empty; single spaces part its words.
    """
    raw = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    counts = np.diff(np.flatnonzero(raw[ends] == 10), prepend=-1)
    return *hashed_words(raw, ends), counts


def text_words(text: str | None) -> tuple[np.ndarray, list[int]]:
    """A hash of each word of a text in lower case, and how many words each of its lines has.

    Words are runs of characters other than space, tab, newline, VT, FF and CR.
    """
    lines = [x.split() for x in (text or "").lower().encode("utf-8", "surrogatepass").split(b"\n")]
    words = [w for x in lines for w in x]
    raw = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    return hashed_words(raw, np.flatnonzero(raw == 32))[0], [len(x) for x in lines]
