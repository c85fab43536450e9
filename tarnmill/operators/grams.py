"""Buckets of word n-grams of many texts at once: what ``textmodel.features`` states by built-in
functions, from the bytes of the texts.

Words joined by single spaces make every n-gram a stretch of bytes. Stretches of a batch are
hashed side by side, eight bytes of each in one step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SPACE = 32
# The seed and the primes of Spark's xxhash64.
SEED = np.uint64(42)
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray) -> np.ndarray:
    return _turned(lane * P2, 31) * P1


def xxhash64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spark's hash of the bytes ``data[start : start + size]``, for many stretches."""
    padded = np.append(data, np.zeros(8, np.uint8))
    # the eight bytes from each place on
    eight = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))
    found = np.full(len(start), SEED + P5)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = np.array([SEED + P1 + P2, SEED + P2, SEED, SEED - P1]) + np.zeros((len(long), 1), np.uint64)
            at, stripes, k, live = start[long], size[long] // 32, 0, np.arange(len(long))
            while len(live):
                read = eight[(at[live] + 32 * k)[:, None] + np.arange(0, 32, 8)]
                lanes[live] = _turned(lanes[live] + read * P2, 31) * P1
                k += 1
                live = live[stripes[live] > k]
            total = sum(_turned(lanes[:, i], bits) for i, bits in enumerate((1, 7, 12, 18)))
            for i in range(4):
                total = (total ^ _round(lanes[:, i])) * P1 + P4
            found[long] = total
        found += size.astype(np.uint64)
        at, rest = start + (size & ~31), size & 31
        for i in range(3):
            own = np.flatnonzero(rest >= 8 * (i + 1))
            found[own] = _turned(found[own] ^ _round(eight[at[own] + 8 * i]), 27) * P1 + P4
        at, rest = at + (rest & 24), rest & 7
        own = np.flatnonzero(rest >= 4)
        found[own] = _turned(found[own] ^ ((eight[at[own]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at, rest = at + (rest & 4), rest & 3
        for i in range(3):
            own = np.flatnonzero(rest > i)
            found[own] = _turned(found[own] ^ (data[at[own] + i].astype(np.uint64) * P5), 11) * P1
        found = (found ^ (found >> np.uint64(33))) * P2
        found = (found ^ (found >> np.uint64(29))) * P3
    return (found ^ (found >> np.uint64(32))).view(np.int64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with one space between words, and (row, start, end) of every word."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = data != SPACE
    opens = np.zeros(len(data) + 1, bool)
    opens[ends] = True
    start = np.flatnonzero(letter & (opens[:-1] | ~np.append(False, letter[:-1])))
    end = np.flatnonzero(letter & (opens[1:] | ~np.append(letter[1:], False))) + 1
    row = np.searchsorted(ends[1:], start, side="right")
    # spaces before the later words of a text stay, all others go
    letter[start[1:][row[1:] == row[:-1]] - 1] = True
    place = np.append(0, np.cumsum(letter))
    return data[letter], row, place[start], place[end]


def numbered(texts: pa.Array, lengths: Sequence[int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: (n-grams in each text, their buckets in order of texts and places)."""
    data, row, start, end = _words(texts)
    for n in lengths:
        first = np.flatnonzero(row[: max(len(row) - n + 1, 0)] == row[n - 1 :])
        hashes = xxhash64(data, start[first], end[first + n - 1] - start[first])
        yield np.bincount(row[first], minlength=len(texts)), hashes % buckets
