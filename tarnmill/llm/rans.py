"""Token ids in a compressed block format by a range asymmetric numeral system.

One static frequency table per data set codes every block. A block holds the ids of whole
documents (or a cut of a very long one), spread over ``lanes`` interleaved coder states,
so numpy codes one id per lane at a time. Blocks are independent: each carries its
lanes' final states as checkpoints, the document bounds and a CRC-32 of ids and payload,
and any of them can be decoded alone and in parallel.

Block layout, all little-endian: magic ``TRN1``, u32 lanes, u64 ids, u32 crc of ids, u32
crc of the rest, u32 words, then the lanes' u64 states and the u32 words in reading order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TRN1"
# the frequencies of a table sum to 2 ** PRECISION
PRECISION = 20
# states lie in [LOW, LOW * 2 ** 32)
LOW = 1 << 31
_HEAD = "<4sIQIII"
MAX_LANES = 2048
IDS_PER_LANE = 128


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies that sum to 2 ** PRECISION, at least 1 for every counted id."""
    total, size = int(counts.sum()), 1 << PRECISION
    used = counts > 0
    if used.sum() >= size:
        raise ValueError(f"more than {size} different ids")
    freq = np.zeros(len(counts), np.int64)
    if total == 0:
        return freq
    spare = size - int(used.sum())
    freq[used] = 1 + np.floor(counts[used] / total * spare).astype(np.int64)
    freq[np.argmax(freq)] += size - int(freq.sum())
    return freq


class Table:
    """Coding and decoding arrays of one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        # the id of every slot
        self.owner = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def lanes_for(n: int) -> int:
    lanes = 1
    while lanes < MAX_LANES and lanes * IDS_PER_LANE * 2 <= n:
        lanes *= 2
    return lanes


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Code ``ids`` (any number, none too)."""
    n = len(ids)
    lanes = lanes_for(n)
    freq, start = table.freq[ids], table.start[ids]
    states = np.full(lanes, LOW, np.uint64)
    shift, half = np.uint64(PRECISION), np.uint64(32)
    # a state must be below freq * 2 ** (63 - PRECISION) before a step
    limit_shift = np.uint64(63 - PRECISION)
    out = []
    for step in range((n + lanes - 1) // lanes - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = states[: b - a], freq[a:b]
        full = np.flatnonzero(x >= (f << limit_shift))
        if len(full):
            out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            x[full] >>= half
        quotient = x // f
        states[: b - a] = (quotient << shift) + (x - quotient * f) + start[a:b]
    words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
    body = states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return struct.pack(_HEAD, MAGIC, lanes, n, crc_of(ids), zlib.crc32(body), len(words)) + body


def decode_block(block: bytes, table: Table) -> np.ndarray:
    """The ids of a block; a wrong checksum raises ``ValueError``."""
    magic, lanes, n, ids_crc, body_crc, n_words = struct.unpack_from(_HEAD, block)
    body = memoryview(block)[struct.calcsize(_HEAD) :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    states = np.frombuffer(body[: 8 * lanes], "<u8").astype(np.uint64)
    words = np.frombuffer(body[8 * lanes : 8 * lanes + 4 * n_words], "<u4").astype(np.uint64)
    out = np.empty(n, np.uint32)
    shift, mask, half = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1), np.uint64(32)
    low = np.uint64(LOW)
    at = 0
    for step in range((n + lanes - 1) // lanes):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = states[: b - a]
        slots = x & mask
        ids = table.owner[slots]
        out[a:b] = ids
        x = table.freq[ids] * (x >> shift) + slots - table.start[ids]
        short = np.flatnonzero(x < low)
        if len(short):
            x[short] = (x[short] << half) | words[at : at + len(short)]
            at += len(short)
        states[: b - a] = x
    if crc_of(out) != ids_crc:
        raise ValueError("ids differ from their checksum")
    return out


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
