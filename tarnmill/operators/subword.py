"""Subword encoding of lines with a fitted vocabulary.

A ``Segmenter`` holds the vocabulary as a trie in flat arrays. It takes all words of a batch at
once: the trie finds every piece in every word, and the recursions go over positions, each step
for all words together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.markers import WORD_START, reserved_symbols
from tarnmill.operators.trie import Trie

# word bytes and lines taken at once; a word that occurs again within them is cut once
BYTES_AT_ONCE = 400_000
LINES_AT_ONCE = 20_000
# cut words that an encoder remembers for the lines that follow; more are cut anew
REMEMBERED = 1 << 19
# Fixed value: score of a character outside the vocabulary, below the worst piece.
UNKNOWN_PENALTY = 10.0


def slices(words: pa.Array, size: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of the words with about ``size`` bytes each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(words):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, stop
        at = stop


class Paths:
    """All pieces of a batch of words, as arcs between places.

    A word of n bytes has the places 0 to n. Those at one offset of all words lie side by side,
    the longest word first, so that an arc's length and its offset tell how far it leads.
    """

    def __init__(self, words: pa.Array):
        column = words.cast(pa.large_string())
        self.bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2] if len(column) else None
        self.data = np.frombuffer(raw, np.uint8)[self.bounds[0] : self.bounds[-1]] if raw is not None and self.bounds[-1] > self.bounds[0] else np.zeros(0, np.uint8)
        self.bounds = self.bounds - self.bounds[0]
        self.sizes = np.diff(self.bounds)
        self.word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.limits = self.bounds[1:][self.word]
        # how many words reach each offset, and where its places begin
        reach = np.cumsum(np.bincount(self.sizes, minlength=1)[::-1])[::-1] if len(self.sizes) else np.zeros(1, np.int64)
        self.begins = np.append(0, np.cumsum(reach))
        self.size = int(self.begins[-1])
        # the first and last place of every word
        self.first = np.empty(len(self.sizes), np.int64)
        self.first[np.argsort(-self.sizes, kind="stable")] = np.arange(len(self.sizes))
        self.last = self.begins[self.sizes] + self.first
        # of every byte: its offset and the place before it; of every place: the byte behind it
        self.offset = np.arange(len(self.data)) - np.repeat(self.bounds[:-1], self.sizes)
        self.place = self.begins[self.offset] + self.first[self.word]
        self.byte = np.empty(self.size, np.int64)
        self.byte[self.last] = self.bounds[1:]
        self.byte[self.place] = np.arange(len(self.data))
        # the bytes in the order of their places
        inner = np.zeros(self.size, bool)
        inner[self.place] = True
        self.order = self.byte[inner]


class Arcs:
    """Arcs from byte ``start`` by a ``piece`` with its ``score``; ``source`` and ``target`` are places.

    They lie in runs of one length and offset, which touch a place once at most.
    """

    def __init__(self, paths: Paths, start: np.ndarray, stop: np.ndarray, piece: np.ndarray, score: np.ndarray):
        self.start, self.piece, self.score = start, piece, score
        size, offset = stop - start, paths.offset[start]
        self.source = paths.place[start]
        self.target = self.source + paths.begins[offset + size] - paths.begins[offset]
        cuts = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (offset[1:] != offset[:-1]))) if len(start) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(start))
        self.cuts, self.ends, self.sizes, self.offsets = cuts, ends, size[cuts], offset[cuts]

    def runs(self, back: bool = False) -> Iterator[slice]:
        """The runs by rising offset (falling, if ``back``), then by rising length."""
        order = np.lexsort((self.sizes, -self.offsets if back else self.offsets))
        for low, high in zip(self.cuts[order].tolist(), self.ends[order].tolist()):
            yield slice(low, high)


class Segmenter:
    """A vocabulary with log probabilities, ready to cut words."""

    def __init__(self, scores: Mapping[str, float]):
        self.pieces = list(scores)
        self.scores = np.array([scores[p] for p in self.pieces], float)
        self.trie = Trie.of([p.encode() for p in self.pieces])
        self.unknown = (float(self.scores.min()) if self.pieces else 0.0) - UNKNOWN_PENALTY

    def arcs(self, paths: Paths, spare: bool, banned: np.ndarray | None = None) -> Arcs:
        """With ``spare``, characters that are no piece get an arc (-1). ``banned`` names a piece
        for each word that it must not use."""
        start, stop, piece = self.trie.matches(paths.data, paths.limits, paths.order)
        score = self.scores[piece]
        if spare:
            head = np.flatnonzero((paths.data & 0xC0) != 0x80)
            after = np.append(head[1:], len(paths.data))
            # a piece that starts here and ends with this character
            ends = np.zeros(len(paths.data) + 1, np.int64)
            ends[head] = after
            known = np.zeros(len(paths.data) + 1, bool)
            known[start[ends[start] == stop]] = True
            lone = head[~known[head]]
            lone = lone[np.lexsort((paths.place[lone], ends[lone] - lone))]
            start, stop = np.append(start, lone), np.append(stop, ends[lone])
            piece, score = np.append(piece, np.full(len(lone), -1)), np.append(score, np.full(len(lone), self.unknown))
        if banned is not None:
            ok = piece != banned[paths.word[start]]
            start, stop, piece, score = start[ok], stop[ok], piece[ok], score[ok]
        return Arcs(paths, start, stop, piece, score)

    def best(self, words: pa.Array, banned: np.ndarray | None = None) -> tuple[Paths, np.ndarray, np.ndarray, np.ndarray]:
        """(paths, score of every place, and the arc by which the best path reaches it: from, piece).

        Of equal paths the one whose last piece is longest counts.
        """
        paths = Paths(words)
        arcs = self.arcs(paths, True, banned)
        total = np.full(paths.size, -np.inf)
        total[paths.first] = 0.0
        by = np.full(paths.size, -1, np.int64)
        for run in arcs.runs():
            value, to = total[arcs.source[run]] + arcs.score[run], arcs.target[run]
            # longer arcs into a place come first, so an equal one changes nothing
            better = np.flatnonzero(value > total[to])
            to = to[better]
            total[to], by[to] = value[better], better + run.start
        reached = by >= 0
        back, piece = np.zeros(paths.size, np.int64), np.full(paths.size, -1, np.int64)
        back[reached], piece[reached] = arcs.source[by[reached]], arcs.piece[by[reached]]
        return paths, total, back, piece

    def cut(self, words: pa.Array) -> pa.ListArray:
        """The pieces of every word on its best path."""
        paths, _, back, _ = self.best(words)
        heads = np.zeros(len(paths.data), bool)
        at, first = paths.last[paths.sizes > 0], paths.first[paths.sizes > 0]
        while len(at):
            at = back[at]
            heads[paths.byte[at]] = True
            open_ = at != first
            at, first = at[open_], first[open_]
        # pieces of one word lie side by side, so the bytes need no copy
        start = np.flatnonzero(heads)
        text = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(start, len(heads)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(paths.data))])
        bounds = np.append(0, np.cumsum(heads))[paths.bounds].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), text.cast(pa.string()))

    def used(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """How often the best paths use each piece."""
        paths, _, back, by = self.best(words)
        at, word = paths.last.copy(), np.arange(len(paths.sizes))
        out = np.zeros(len(self.pieces))
        while len(at):
            open_ = at != paths.first[word]
            at, word = at[open_], word[open_]
            known = by[at] >= 0
            out += np.bincount(by[at][known], weights=counts[word][known], minlength=len(out))
            at = back[at]
        return out

    def loss(self) -> np.ndarray:
        """The score lost by writing each piece with others; 0 for single characters."""
        lost = np.zeros(len(self.pieces))
        words = pa.array(self.pieces, pa.large_string())
        for start, stop in slices(words):
            paths, total, _, _ = self.best(words.slice(start, stop - start), np.arange(start, stop))
            lost[start:stop] = self.scores[start:stop] - total[paths.last]
        lost[[len(p) == 1 for p in self.pieces]] = 0.0
        return lost

    def expected(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations, words taken ``counts`` times;
        a word that the pieces cannot spell counts nothing."""
        paths = Paths(words)
        arcs = self.arcs(paths, False)
        ahead, behind = np.full(paths.size, -np.inf), np.full(paths.size, -np.inf)
        ahead[paths.first], behind[paths.last] = 0.0, 0.0
        for run in arcs.runs():
            to = arcs.target[run]
            ahead[to] = np.logaddexp(ahead[to], ahead[arcs.source[run]] + arcs.score[run])
        for run in arcs.runs(back=True):
            at = arcs.source[run]
            behind[at] = np.logaddexp(behind[at], behind[arcs.target[run]] + arcs.score[run])
        word = paths.word[arcs.start]
        total = ahead[paths.last][word]
        spelt = total > -np.inf
        share = np.exp(ahead[arcs.source[spelt]] + arcs.score[spelt] + behind[arcs.target[spelt]] - total[spelt])
        return np.bincount(arcs.piece[spelt], weights=share * counts[word[spelt]], minlength=len(self.pieces))


class Encoder:
    """Pieces of whole lines."""

    def __init__(self, segmenter: Segmenter, symbols: list[str]):
        self.segmenter, self.symbols = segmenter, pa.array(symbols, pa.large_string())
        self.known, self.pieces = pa.array([], pa.large_string()), pa.array([], pa.list_(pa.string()))

    def words(self, words: pa.Array) -> pa.ListArray:
        """The pieces of distinct words; those of words seen before are remembered."""
        found = pc.index_in(words, self.known)
        fresh = words.filter(found.is_null())
        cut = self.fresh(fresh)
        number = found.fill_null(0).to_numpy().copy()
        number[found.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        known, pieces = pa.concat_arrays([self.known, fresh]), pa.concat_arrays([self.pieces, cut])
        out = pieces.take(pa.array(number))
        self.known, self.pieces = (known, pieces) if len(known) <= REMEMBERED else (words, out)
        return out

    def fresh(self, words: pa.Array) -> pa.ListArray:
        """The pieces of words, each of them cut."""
        whole = pc.is_in(words, self.symbols)
        plain = words.filter(pc.invert(whole))
        parts = []
        marked = pc.binary_join_element_wise(pa.scalar(WORD_START, pa.large_string()), plain, pa.scalar("", pa.large_string()))
        for start, stop in slices(marked):
            parts.append(self.segmenter.cut(marked.slice(start, stop - start)))
        lone = words.filter(whole).cast(pa.string())
        parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(lone) + 1, dtype=np.int32)), lone))
        # back to the order of the words
        number = np.append(np.flatnonzero(~whole.to_numpy(zero_copy_only=False)), np.flatnonzero(whole.to_numpy(zero_copy_only=False)))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(number)))

    def lines(self, lines: pa.Array) -> pa.ListArray:
        """The pieces of every line; a null line has none."""
        texts = pc.utf8_normalize(pc.fill_null(lines.cast(pa.large_string()), ""), "NFKC")
        split = pc.utf8_split_whitespace(texts)
        words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        coded = words.dictionary_encode()
        number = coded.indices.to_numpy()
        # a line that begins or ends with white space yields an empty word there
        filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
        distinct = self.words(coded.dictionary)
        kept = filled[number] if len(number) else np.zeros(0, bool)
        before = np.append(0, np.cumsum(kept))
        pieces = distinct.take(pa.array(number[kept]))
        # pieces of a line: those of its words in a row
        word_ends = pieces.offsets.to_numpy().astype(np.int64)
        bounds = word_ends[before[offsets]]
        return pa.ListArray.from_arrays(pa.array((bounds - word_ends[0]).astype(np.int32)), pieces.flatten())


def encode_lines(lines: Column, scores: Mapping[str, float], num_reserved: int = 0) -> Column:
    """Pieces of every line. ``scores`` maps pieces to log probabilities and must be a
    vocabulary (its size is the bound of what is sent to the tasks).

    Words are normalised (NFKC) and start with a word mark; reserved symbols stay whole.
    """
    symbols = list(reserved_symbols(num_reserved))
    segmenter = Segmenter(scores)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(segmenter, symbols)
        for column in batches:
            for start, stop in line_slices(column):
                part = column.slice(start, stop - start)
                flat = encoder.lines(part.flatten())
                bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(bounds), flat, mask=part.is_null())

    return F.arrow_udf(encode, T.ArrayType(T.ArrayType(T.StringType()))).asNondeterministic()(lines)


def line_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``LINES_AT_ONCE`` lines each."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINES_AT_ONCE, side="right")))
        yield at, stop
        at = stop
