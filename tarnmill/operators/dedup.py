"""Similarity hash per file and removal of files with an equal hash."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.tasks import row_function

# Gram width of the similarity hash and the characters it leaves out.
GRAM_WIDTH = 4
NOT_WORD = re.compile(r"\W+")

MEMO_GRAMS = 1 << 18
NEW_GRAMS = 1 << 13
PIECE_CHARS = 1 << 20
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def _low_digest(gram: str) -> int:
    return int.from_bytes(md5(gram.encode()).digest()[8:], "big")


class _Digests:
    """Digests of packed grams already seen by this task, sorted by gram.

    New grams go to a small table first, which joins the large one when it is full, so that
    no file copies the large one.
    """

    def __init__(self):
        # the empty gram never occurs packed, so it can stand in front
        self.grams, self.digests = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.new_grams, self.new_digests = self.grams, self.digests

    def of(self, grams: np.ndarray) -> np.ndarray:
        found = np.zeros(len(grams), np.uint64)
        left = np.arange(len(grams))
        for known, digests in ((self.grams, self.digests), (self.new_grams, self.new_digests)):
            place = np.minimum(np.searchsorted(known, grams[left]), len(known) - 1)
            hit = known[place] == grams[left]
            found[left[hit]] = digests[place[hit]]
            left = left[~hit]
        if len(left):
            unseen = grams[left]
            letters = unseen.astype(">u8").tobytes().decode("utf-16-be")
            found[left] = [_low_digest(letters[i : i + GRAM_WIDTH]) for i in range(0, len(letters), GRAM_WIDTH)]
            self.new_grams, self.new_digests = self._merged(self.new_grams, self.new_digests, unseen, found[left])
        if len(self.new_grams) > NEW_GRAMS:
            if len(self.grams) > MEMO_GRAMS:
                self.grams, self.digests = self.new_grams, self.new_digests
            else:
                self.grams, self.digests = self._merged(self.grams, self.digests, self.new_grams[1:], self.new_digests[1:])
            self.new_grams, self.new_digests = self.grams[:1], self.digests[:1]
        return found

    @staticmethod
    def _merged(grams, digests, more_grams, more_digests):
        every = np.concatenate([grams, more_grams])
        order = np.argsort(every, kind="stable")
        return every[order], np.concatenate([digests, more_digests])[order]


def _weighted_digests(text: str, memo: _Digests) -> tuple[np.ndarray, np.ndarray]:
    """Digest and count of every distinct gram."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < GRAM_WIDTH or codes.max() > 0xFFFF or ((codes >= 0xD800) & (codes < 0xE000)).any():
        grams = Counter(text[i : i + GRAM_WIDTH] for i in range(max(len(text) - GRAM_WIDTH + 1, 1)))
        return np.array([_low_digest(g) for g in grams], np.uint64), np.array([*grams.values()])
    # four 16-bit characters pack into one integer
    packed = codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]
    grams, counts = np.unique(packed, return_counts=True)
    return memo.of(grams), counts


def _vote(text: str, memo: _Digests) -> int:
    """Weighted bit vote over the grams of one file, as a signed 64-bit pattern.

    Votes add up, so a long text goes through in pieces; each gram starts in one piece.
    """
    kept = NOT_WORD.sub("", text.lower())
    ones, total = np.zeros(64), 0
    for start in range(0, max(len(kept) - GRAM_WIDTH + 1, 1), PIECE_CHARS):
        digests, counts = _weighted_digests(kept[start : start + PIECE_CHARS + GRAM_WIDTH - 1], memo)
        octets = digests.astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(octets[:, k], counts, 256) @ _BIT_OF_BYTE for k in range(8)])
        total += counts.sum()
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _voter():
    memo = _Digests()
    return lambda text: None if text is None else _vote(text, memo)


_simhash = row_function(T.LongType(), _voter)


def simhash(text: Column) -> Column:
    """64-bit similarity hash of a text.

    Overlapping four-character grams of the lower-cased word characters vote on each
    bit with the low half of their MD5 digest; a bit is set when more than half of the
    grams have it. Runs inside each row, so it needs no shuffle. Counting distinct
    grams first and remembering digests per task is several times faster than exploding
    the grams into rows and hashing each with built-in functions (see README).
    """
    return _simhash(text)


def unique_files(meta: DataFrame, key: str = "file_id") -> DataFrame:
    """The first file in key order of every hash, with ``copies`` = files that share it.

    Grouping with partial aggregation keeps a group of copies of any size out of a
    single task: each task sends at most one row per hash.
    """
    fields = [key] + [c for c in meta.columns if c != key]
    best = meta.groupBy("hash").agg(
        F.min(F.struct(*fields)).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    return best.select("first.*", "copies")


def duplicate_count(unique: DataFrame) -> DataFrame:
    """Number of files dropped as duplicates, one row."""
    return unique.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))
