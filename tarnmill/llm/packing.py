"""Packing documents into token windows by non-negative least squares.

Documents longer than a window fill whole windows first. For the remainders, pairs and
triples of lengths that fill a window exactly are enumerated; non-negative least squares
finds how often each should be used to match the histogram of lengths; the counts are
rounded and taken as far as lengths last, so their documents stay uncut. What is left is laid
end to end, cut where a window is full. The last, partly filled window of a
task is cut into sequences of power-of-two length, so no sequence needs padding.

Each task packs its own documents in groups of about ``GROUP_IDS`` ids and carries the
open window from group to group: nothing is shuffled or gathered. Sequence ids are the
task's number shifted left by 33 bits plus a counter.

Null and empty texts hold the end id alone. Repeated rows and ids, and null ids, are packed as
documents of their own. An empty table gives no sequences. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import chunks
from tarnmill.llm.tokens import TOKEN_CHUNK, encode_with_end, tokenizer_path

WINDOW = 4096
END_ID = 2
GROUP_IDS = 2_000_000
# documents by which the solution may miss the optimality of a combination
TOLERANCE = 0.25


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of all two or three places in ``lengths`` (ascending) whose lengths sum to ``window``; -1 pads."""
    place = np.full(window + 1, -1)
    place[lengths] = np.arange(len(lengths))
    first = np.flatnonzero(2 * lengths <= window)
    second = place[window - lengths[first]]
    pairs = np.stack([first, second, np.full(len(first), -1)], axis=1)[second >= 0]
    triples = []
    for a in np.flatnonzero(3 * lengths <= window):
        b = np.arange(a, len(lengths))
        b = b[lengths[a] + 2 * lengths[b] <= window]
        c = place[window - lengths[a] - lengths[b]]
        b, c = b[c >= 0], c[c >= 0]
        triples.append(np.stack([np.full(len(b), a), b, c], axis=1))
    return np.concatenate([pairs, *triples])


def least_squares(members: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 that brings the lengths used by x times each combination nearest to ``counts``.

    Accelerated projected gradients, a step size for each combination, until every
    combination is optimal: its gradient vanishes, or is not negative where x is 0, up to
    ``TOLERANCE`` of a document (or a ten-thousandth of the largest count).
    """
    n = len(counts)
    places = np.where(members >= 0, members, n)

    def lengths_used(x: np.ndarray) -> np.ndarray:
        return np.bincount(places.ravel(), weights=np.repeat(x, 3), minlength=n + 1)[:n]

    def back(residual: np.ndarray) -> np.ndarray:
        return np.append(residual, 0.0)[places].sum(axis=1)

    step = 1 / back(lengths_used(np.ones(len(members))))
    enough = max(TOLERANCE, 1e-4 * counts.max())
    x = y = np.zeros(len(members))
    momentum = 1.0
    while True:
        gradient = back(lengths_used(y) - counts)
        if np.abs(np.minimum(y, gradient)).max() <= enough:
            return y
        new = np.maximum(0.0, y - step * gradient)
        if ((new - x) * (y - new)).sum() > 0:
            # the momentum leads uphill
            x, y, momentum = new, new, 1.0
            continue
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = np.maximum(0.0, new + (momentum - 1) / following * (new - x))
        x, momentum = new, following


def recipes(remainders: np.ndarray, window: int) -> list[tuple[np.ndarray, int]]:
    """(lengths that fill a window, how many such windows) within the given remainders."""
    lengths, counts = np.unique(remainders, return_counts=True)
    members = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), int)
    if not len(members):
        return []
    solved = least_squares(members, counts.astype(float))
    left, out = counts.copy(), []
    order = np.argsort(-solved, kind="stable")
    # the rounded counts first, then whatever the rounding has left over
    for wanted in (np.rint(solved).astype(np.int64), np.full(len(solved), np.iinfo(np.int64).max)):
        there = ((members < 0) | (left[members] > 0)).all(axis=1)
        for k in order[(wanted[order] > 0) & there[order]]:
            own = [m for m in members[k] if m >= 0]
            times = min([int(wanted[k]), *(int(left[m]) // own.count(m) for m in own)])
            if times > 0:
                for m in own:
                    left[m] -= times
                out.append((lengths[own], times))
    return out


class Packer:
    """Packs groups of documents; ``pieces`` are (group row, start, length, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []  # (document, start, length) of the window being filled
        self.filled = 0

    def close(self, parts: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for document, start, length in parts:
            yield document, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def pack(self, documents: list, sizes: np.ndarray) -> Iterator[tuple]:
        """Pieces of all windows that this group fills."""
        w = self.window
        by_length = defaultdict(list)
        for k, size in enumerate(sizes.tolist()):
            for start in range(0, size - size % w, w):
                yield from self.close([(documents[k], start, w)])
            if size % w:
                by_length[size % w].append(k)
        remainders = np.repeat(np.array(list(by_length), np.int64), [len(v) for v in by_length.values()])
        for lengths, times in recipes(remainders, w):
            for _ in range(times):
                own = [by_length[length].pop() for length in lengths.tolist()]
                yield from self.close([(documents[k], int(sizes[k]) - length, length) for k, length in zip(own, lengths.tolist())])
        for k in sorted(k for rest in by_length.values() for k in rest):
            start, length = int(sizes[k]) - int(sizes[k]) % w, int(sizes[k]) % w
            while length:
                part = min(length, w - self.filled)
                self.open.append((documents[k], start, part))
                self.filled += part
                start, length = start + part, length - part
                if self.filled == w:
                    yield from self.close(self.open)
                    self.open, self.filled = [], 0

    def finish(self) -> Iterator[tuple]:
        """Pieces of the open window, in sequences of power-of-two length."""
        room, parts = 1 << (self.filled.bit_length() - 1) if self.filled else 0, []
        for document, start, length in self.open:
            while length:
                part = min(length, room)
                parts.append((document, start, part))
                start, length, room = start + part, length - part, room - part
                self.filled -= part
                if room == 0:
                    yield from self.close(parts)
                    room, parts = 1 << (self.filled.bit_length() - 1) if self.filled else 0, []
        self.open, self.filled = [], 0


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    piece's ids if asked for."""
    path = tokenizer or tokenizer_path()
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = encode_with_end(path, end_id), Packer(TaskContext.get().partitionId() << 33, window)
        arrow_id = None
        group: list[tuple] = []
        held = 0

        def rows(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            found = list(pieces)
            if not found:
                return
            cut = [document[1][start : start + length] for document, start, length, _, _ in found]
            columns = [
                pa.array([p[0][0] for p in found], arrow_id),
                pa.array([p[1] for p in found], pa.int64()),
                pa.array([p[2] for p in found], pa.int64()),
                pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in cut], pa.int64()),
                pa.array([len(p[0][1]) for p in found], pa.int64()),
                pa.array([p[3] for p in found], pa.int64()),
                pa.array([p[4] for p in found], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(cut, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names)

        def flush() -> Iterator[pa.RecordBatch]:
            yield from rows(packer.pack(group, np.array([len(d[1]) for d in group], np.int64)))

        for part in chunks(batches, limit=TOKEN_CHUNK):
            arrow_id = part.schema.field("doc_id").type
            ids, bounds = ids_of(part.column("text"))
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds, bounds[1:]):
                group.append((doc_id, ids[a:b]))
            held += len(ids)
            if held >= GROUP_IDS:
                yield from flush()
                group, held = [], 0
        if group:
            yield from flush()
        yield from rows(packer.finish())

    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
