"""Vectorised word hashing over UTF-8 text: words of a batch become 64-bit hashes without Python loops per word.

A word is a maximal run of bytes outside ``0x20, 0x09-0x0D`` (the class ``[^\\x20\\x09-\\x0D]+``;
in UTF-8 a byte below 0x80 is always a character of its own). Hashes are polynomial over a
random byte table modulo 2**64 and then mixed, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C4B  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 2**64)
_SLOT = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS


class Words:
    """Words of some texts: hash, first and past-the-end byte of each, and bounds of each text's words."""

    def __init__(self, texts: list[bytes], lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.blob = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_start, self.text_end = np.concatenate(([0], ends[:-1])), ends - 1
        inside = np.zeros(len(self.blob) + 2, np.int8)
        inside[1:-1] = ~separator[self.blob]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        power, inverse = _powers(len(self.blob) + 1)
        total = np.zeros(len(self.blob) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[self.blob] if lower else self.blob] * power[: len(self.blob)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.bounds = np.searchsorted(self.start, np.concatenate(([0], ends)))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 words have none."""
        count = max(0, len(self.hash) - n + 1)
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out += self.hash[k : k + count] * _SLOT[k]
        return mix(out + np.uint64(n))


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence of fewer than 64 words."""
    return mix((words * _SLOT[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))[0]


def slices(batches, rows: int = 1000) -> Iterator:
    """Arrow batches in pieces of at most so many rows, so that few texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes (one text at least), with the first one's place; null is empty."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        if held and total + len(raw) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(raw)
        total += len(raw)
    if held:
        yield first, held
