"""Benchmark decontamination by latent semantic retrieval.

1. Terms are all words of the benchmark, whose equal texts are one item. One pass over all documents
   counts in how many passages (24 words) each term occurs and accumulates the sketch
   C W of the terms' co-occurrence C = T'T with a fixed random W, summed over tasks. Scaled by the inverse
   document frequencies D it is the sketch (DCD)(W/D) of a randomised eigendecomposition,
   as W/D is a random test matrix too, so a single pass gives the SVD of the TF-IDF
   passages. The benchmark's own passages join the sketch with the same total energy.
2. A second pass projects overlapping windows and the items to the leading singular
   directions; windows with a cosine of ``COSINE`` to an item are candidates.
3. A candidate counts if the longest common subsequence of words with the text around it
   covers ``COVER`` of the item and the item's answer, where the benchmark has one,
   occurs there to ``ANSWER``. Items under ``SHORT`` words must occur in full.
4. The same pass searches exactly, whatever the cosines are. Short items are looked up by the hashes of
   all word n-grams of their lengths. A longer item of n words that shares t = ``COVER`` n of them
   with a stretch of text (2 n words and a window) shares at least k of its n - t + k rarest
   words, so each stretch that holds k of these (k a third of n) is compared. So every
   item is found that some stretch covers.

The benchmark is the query set: it is read in blocks of ``BLOCK_ITEMS`` items, and each block is
compared with all documents. What a task holds is bounded by a block's terms.

Result: one row for each document and item found in it: doc_id, item_id, item_words,
lcs_words. Words are lower-cased runs of letters and digits. Null and
empty texts hold nothing, null, empty and repeated items are passed over or found under
each of their ids, repeated rows and null doc_ids give rows of their own, and empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnmill.llm.common import ALNUM, bytes_of, chunks, span_hashes, window_hashes, word_bounds

HALF = 12
DIMENSIONS = 128
OVERSAMPLE = 16
COSINE = 0.6
COVER = 0.6
ANSWER = 0.6
SHORT = 8
BLOCK_ITEMS = 4096
# word occurrences of items compared at once
PAIRS = 2_000_000
# texts of at most so many words are bounded whole before their stretches
WHOLE = 4096
SLICE = 256


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, row) of all words."""
    data, bounds = bytes_of(column)
    starts, stops, rows = word_bounds(data, bounds, ALNUM)
    return span_hashes(data, starts, stops, lower=True), rows


class Block:
    """A block of benchmark items, each with all its ids: their words, terms and answers."""

    def __init__(self, item_ids: list[list], texts: list[str], answers: list[str | None]):
        hashes, rows = words_of(pa.array([t.lower() for t in texts], pa.string()))
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        keep = [k for k in range(len(texts)) if bounds[k + 1] > bounds[k]]
        self.ids = [item_ids[k] for k in keep]
        self.words = [hashes[bounds[k] : bounds[k + 1]] for k in keep]
        self.answers = [answer_words(answers[k]) for k in keep]
        self.terms = np.unique(np.concatenate(self.words) if keep else np.zeros(0, np.uint64))
        # a place of the table for each term, by the low bits of its hash; those that share one are searched for
        self.slots = np.uint64((1 << max(10, (16 * len(self.terms)).bit_length())) - 1)
        slot = (self.terms & self.slots).astype(np.int64)
        self.table = np.full(int(self.slots) + 1, -1, np.int32)
        self.table[slot] = np.arange(len(self.terms))
        self.shared = np.bincount(slot, minlength=len(self.table)) > 1

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the terms, or -1."""
        out = np.full(len(hashes), -1)
        slot = (hashes & self.slots).astype(np.int64)
        at = self.table[slot]
        likely = np.flatnonzero(at >= 0)
        hit = likely[self.terms[at[likely]] == hashes[likely]]
        out[hit] = at[hit]
        several = likely[self.shared[slot[likely]]]
        if len(several):
            at = np.minimum(np.searchsorted(self.terms, hashes[several]), len(self.terms) - 1)
            out[several] = np.where(self.terms[at] == hashes[several], at, -1)
        return out


class Exact:
    """Tables for the exact search: n-gram hashes of short items, rare words of the others."""

    def __init__(self, block: Block, df: np.ndarray):
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n_terms = len(block.terms)
        sizes = np.array([len(words) for words in block.words], np.int64)
        for width in np.unique(sizes[sizes < SHORT]).tolist():
            items = np.flatnonzero(sizes == width)
            grams = np.array([window_hashes(block.words[k], width)[0] for k in items], np.uint64)
            order = np.argsort(grams, kind="stable")
            self.short[width] = grams[order], items[order]
        self.least = np.ceil(COVER * sizes - 1e-9).astype(np.int64)
        self.hits = (sizes + 2) // 3
        self.stretch = 2 * sizes + 2 * HALF
        rare = [np.zeros(0, np.int64)] * len(sizes)
        for k in np.flatnonzero(sizes >= SHORT):
            term = block.term_of(block.words[k])
            rare[k] = np.unique(term[np.argsort(df[term], kind="stable")][: sizes[k] - self.least[k] + self.hits[k]])
        self.term = np.concatenate(rare) if len(rare) else np.zeros(0, np.int64)
        self.bounds = np.append(0, np.cumsum([len(r) for r in rare])).astype(np.int64)
        self.item = np.repeat(np.arange(len(rare)), np.diff(self.bounds))
        # the distinct terms of every item, with their numbers of occurrences
        distinct = [np.unique(block.term_of(words), return_counts=True) for words in block.words]
        self.terms, self.times = (np.concatenate([d[k] for d in distinct]) if distinct else np.zeros(0, np.int64) for k in (0, 1))
        self.terms_of = np.append(0, np.cumsum([len(d[0]) for d in distinct])).astype(np.int64)
        self.masks = [word_masks(words) for words in block.words]

    def short_items(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, words) of the short items that occur in full."""
        for width, (grams, items) in self.short.items():
            own = window_hashes(hashes, width)
            own_rows = rows[: len(own)]
            begin = np.searchsorted(grams, own)
            hit = np.flatnonzero((grams[np.minimum(begin, len(grams) - 1)] == own) & (own_rows == rows[width - 1 :][: len(own)]))
            n = np.searchsorted(grams, own[hit], "right") - begin[hit]
            at = np.repeat(begin[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs = np.unique(np.repeat(own_rows[hit], n).astype(np.int64) * len(self.least) + items[at])
            for pair in pairs.tolist():
                yield pair // len(self.least), pair % len(self.least), width

    def places(self, term: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, first, last) of the places with enough of an item's rare words in a stretch."""
        known = np.flatnonzero(term >= 0)
        slim = term[known]
        known = known[np.argsort(slim.astype(np.uint16) if self.n_terms <= 1 << 16 else slim, kind="stable")]
        if not len(self.term) or not len(known):
            return
        cuts = np.searchsorted(term[known], np.arange(int(self.term.max()) + 2))
        sizes = np.diff(cuts)[self.term]
        total = np.append(0, np.cumsum(sizes))[self.bounds]
        i = 0
        while i < len(total) - 1:
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
            part = slice(self.bounds[i], self.bounds[j])
            i, n = j, sizes[part]
            spots = known[np.repeat(cuts[self.term[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            key = np.repeat(self.item[part], n) * len(term) + spots
            key.sort()
            item, spot = key // len(term), key % len(term)
            last = np.arange(len(key)) + self.hits[item] - 1
            live = np.flatnonzero(last < len(key))
            last = last[live]
            near = (item[last] == item[live]) & (rows[spot[last]] == rows[spot[live]]) & (spot[last] - spot[live] < self.stretch[item[live]])
            live, last = live[near], last[near]
            yield item[live], spot[live], spot[last]


    def common(self, items: np.ndarray, starts: np.ndarray, stops: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Words that an item and a stretch of words have in common in any order, for each
        pair of the two; the longest common subsequence is no longer."""
        out = np.zeros(len(items), np.int64)
        cost = np.append(0, np.cumsum(stops - starts + np.diff(self.terms_of)[items]))
        i = 0
        while i < len(items):
            j = max(i + 1, int(np.searchsorted(cost, cost[i] + PAIRS // 4, side="right")) - 1)
            pair, width = np.arange(j - i), len(self.terms_of) + int(self.terms.max()) + 1
            sizes = stops[i:j] - starts[i:j]
            found = term[ranges(starts[i:j], sizes)]
            keys, counts = np.unique((np.repeat(pair, sizes) * width + found)[found >= 0], return_counts=True)
            n = np.diff(self.terms_of)[items[i:j]]
            own = ranges(self.terms_of[items[i:j]], n)
            owner = np.repeat(pair, n)
            wanted = owner * width + self.terms[own]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                shared = np.where(keys[at] == wanted, np.minimum(counts[at], self.times[own]), 0)
                out[i:j] = np.bincount(owner, weights=shared, minlength=j - i)
            i = j
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def covered(block: Block, exact: Exact, item: int, hashes: np.ndarray, term: np.ndarray, start: int, stop: int, first: int, last: int) -> int:
    """Words of the longest common subsequence with a stretch of ``hashes[start:stop]`` that
    holds the words ``first`` to ``last`` and the item's answer, or 0 below the least cover."""
    answer, least, size, masks = block.answers[item], int(exact.least[item]), int(exact.stretch[item]), exact.masks[item]
    a, b = max(start, last - size + 1), min(stop, first + size)
    # words that the item lacks change no common subsequence
    inside = a + np.flatnonzero(np.isin(term[a:b], exact.terms[exact.terms_of[item] : exact.terms_of[item + 1]]))
    if len(inside) < least or subsequence(masks, hashes[inside]) < least:
        return 0
    best = 0
    for begin in sorted({a, *inside[inside <= first].tolist()}):
        end = min(stop, begin + size)
        n = subsequence(masks, hashes[inside[np.searchsorted(inside, begin) : np.searchsorted(inside, end)]])
        if n > best and n >= least and np.isin(answer, hashes[begin:end]).sum() >= ANSWER * len(answer):
            best = n
            if n == len(block.words[item]):
                break
    return best


def answer_words(answer: str | None) -> np.ndarray:
    return np.unique(words_of(pa.array([(answer or "").lower()], pa.string()))[0])


def half_blocks(rows: np.ndarray) -> np.ndarray:
    """For words in row order: the number of their run of HALF words, all rows' runs in a line."""
    if not len(rows):
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    counts = np.diff(np.append(begins, len(rows)))
    local = (np.arange(len(rows)) - np.repeat(begins, counts)) // HALF
    runs = (counts + HALF - 1) // HALF
    return np.repeat(np.cumsum(runs) - runs, counts) + local


def test_matrix(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((n, width)).astype(np.float32)


def run_sums(basis: np.ndarray, terms: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """Sum of the terms' rows of ``basis`` over each of ``n`` short runs (``runs`` ascending).

    The k-th terms of all runs are added at once, as no run then occurs twice."""
    sums = np.zeros((n, basis.shape[1]), basis.dtype)
    if not len(terms):
        return sums
    begins = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    lengths = np.diff(np.append(begins, len(runs)))
    for k in range(int(lengths.max())):
        at = begins[lengths > k] + k
        sums[runs[at]] += basis[terms[at]]
    return sums


def sketch_of(terms: np.ndarray, passages: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(terms present, rows of T'TW for them, passages per term, passages) of term occurrences,
    whose passages do not fall."""
    place = np.cumsum(changes(passages)) - 1
    n = int(place[-1]) + 1 if len(place) else 0
    y = run_sums(w, terms, place, n)
    # 16-bit numbers sort in linear time
    slim = terms.astype(np.uint16) if len(w) <= 1 << 16 else terms
    order = np.argsort(slim, kind="stable")
    ordered, place = terms[order], place[order]
    fresh = changes(ordered)
    first = np.flatnonzero(fresh)
    z = group_sums(y, place, first)
    # in this order the passages of one term do not fall either
    df = np.add.reduceat((fresh | changes(place)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return ordered[first], z, df, n


def group_sums(table: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of ``table`` over the groups that begin at ``first``.

    Rows are added by fours first, some at a time: sums of equally many rows are cheap, and what is at hand stays in the cache."""
    if not len(first):
        return np.zeros((0, table.shape[1]), table.dtype)
    sizes = np.diff(np.append(first, len(at)))
    fours = (sizes + 3) // 4
    begins = np.cumsum(fours) - fours
    index = np.full(4 * int(fours.sum()), len(table))
    index[np.repeat(4 * begins - first, sizes) + np.arange(len(at))] = at
    table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    out = np.empty((len(index) // 4, table.shape[1]), table.dtype)
    for k in range(0, len(out), 512):
        some = table[index[4 * k : 4 * (k + 512)]].reshape(-1, 4, table.shape[1])
        np.add(some[:, 0] + some[:, 1], some[:, 2] + some[:, 3], out=out[k : k + 512])
    return np.add.reduceat(out, begins, axis=0)


def changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def corpus_sketch(texts: DataFrame, block: Block) -> tuple[np.ndarray, np.ndarray, int]:
    """(T'TW, passages per term, all passages) over every document."""
    n, width = len(block.terms), min(DIMENSIONS + OVERSAMPLE, max(1, len(block.terms)))
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = shared.value, test_matrix(n, width)
        z, df, passages = np.zeros((n, width), np.float32), np.zeros(n, np.int64), 0
        for part in chunks(batches):
            hashes, rows = words_of(part.column("text"))
            term = block.term_of(hashes)
            passage = half_blocks(rows) // 2
            passages += int(changes(passage).sum())
            known = term >= 0
            if known.any():
                present, more, counts, _ = sketch_of(term[known], passage[known], w)
                z[present] += more
                df[present] += counts
        for number in range(0, max(n, 1), SLICE):
            cut = slice(number, number + SLICE)
            columns = [pa.array([number // SLICE], pa.int32()), pa.array([z[cut].astype("<f8").tobytes()], pa.binary()), pa.array([df[cut].tobytes()], pa.binary()), pa.array([passages], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "z", "df", "passages"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, z, df, passages = None, None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([z.tobytes()]), pa.array([df.tobytes()]), pa.array([passages], pa.int64())], ["slice", "z", "df", "passages"])

        for batch in batches:
            for number, a, b, count in zip(*(c.to_pylist() for c in batch.columns)):
                if number != current:
                    if current is not None:
                        yield done()
                    current, z, df, passages = number, np.frombuffer(a, "<f8").copy(), np.frombuffer(b, np.int64).copy(), count
                else:
                    z += np.frombuffer(a, "<f8")
                    df += np.frombuffer(b, np.int64)
                    passages += count
        if current is not None:
            yield done()

    kind = "slice int, z binary, df binary, passages bigint"
    summed = texts.select("text").mapInArrow(run, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(add, kind)
    z, df, passages = np.zeros((n, width)), np.zeros(n, np.int64), 0
    for row in summed.toLocalIterator():
        cut = slice(row["slice"] * SLICE, row["slice"] * SLICE + SLICE)
        z[cut] = np.frombuffer(row["z"], "<f8").reshape(-1, width)
        df[cut], passages = np.frombuffer(row["df"], np.int64), row["passages"]
    shared.destroy()
    return z, df, passages


def directions(block: Block, z: np.ndarray, df: np.ndarray, passages: int) -> np.ndarray:
    """Rows for the terms: inverse document frequency times the leading singular directions."""
    n, width = z.shape
    w = test_matrix(n, width).astype(np.float64)
    term = np.concatenate([block.term_of(words) for words in block.words])
    owner = np.repeat(np.arange(len(block.words)), [len(words) for words in block.words])
    known = term >= 0
    present, more, counts, own_passages = sketch_of(term[known], owner[known], w.astype(np.float32))
    idf = np.log1p((passages + own_passages) / (df + 1.0))
    own = np.zeros_like(z)
    own[present] = more
    corpus_energy, own_energy = (df * idf**2).sum(), (counts * idf[present] ** 2).sum()
    y = idf[:, None] * (z + own * max(1.0, corpus_energy / own_energy))
    test = w / idf[:, None]
    core = test.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    left, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return (idf[:, None] * left[:, :DIMENSIONS]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def item_vectors(block: Block, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((len(block.words), basis.shape[1]), np.float32)
    for k, words in enumerate(block.words):
        term = block.term_of(words)
        out[k] = basis[term[term >= 0]].sum(axis=0)
    return unit(out)


def windows(term: np.ndarray, rows: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, vector) of every window of two neighbouring runs of words."""
    run = half_blocks(rows)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, int)
    ends = np.append(first[1:], len(run))
    known = np.flatnonzero(term >= 0)
    sums = run_sums(basis, term[known], run[known], len(first))
    row = rows[first]
    joined = np.append(row[1:] == row[:-1], False)
    sums[:-1][joined[:-1]] += sums[1:][joined[:-1]]
    stop = ends.copy()
    stop[:-1][joined[:-1]] = ends[1:][joined[:-1]]
    return first, stop, sums


def word_masks(item: np.ndarray) -> tuple[dict[int, int], int]:
    """For each word of the item a number with the bits of its places; the item's length."""
    masks: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | (1 << k)
    return masks, len(item)


def subsequence(item: tuple[dict[int, int], int], text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    masks, n = item
    full = (1 << n) - 1
    state = full
    for word in text.tolist():
        match = state & masks.get(word, 0)
        state = ((state + match) | (state - match)) & full
    return n - state.bit_count()


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    return subsequence(word_masks(item), text)


def holds(item: np.ndarray, answer: np.ndarray, text: np.ndarray) -> int:
    """Words of the common subsequence if the text holds the item, else 0."""
    there = set(text.tolist())
    # words in common bound the subsequence
    if sum(map(there.__contains__, item.tolist())) < COVER * len(item):
        return 0
    found = common_subsequence(item, text)
    if len(item) < SHORT:
        views = np.lib.stride_tricks.sliding_window_view(text, len(item)) if len(text) >= len(item) else np.zeros((0, len(item)), np.uint64)
        return found if (views == item).all(axis=1).any() else 0
    if found < COVER * len(item):
        return 0
    return found if not len(answer) or np.isin(answer, text).sum() >= ANSWER * len(answer) else 0


def search(column: pa.Array, block: Block, basis: np.ndarray, items: np.ndarray, exact: Exact) -> list[tuple[int, int, int]]:
    """(row, item, common words) of the items found in a chunk of texts."""
    hashes, rows = words_of(column)
    term = block.term_of(hashes)
    first, stop, vectors = windows(term, rows, basis)
    live = np.flatnonzero((vectors != 0).any(axis=1))
    row_start, row_stop = np.searchsorted(rows, np.arange(len(column))), np.searchsorted(rows, np.arange(len(column)), side="right")
    found = {(row, item): n for row, item, n in exact.short_items(hashes, rows)}
    for item, low, high in exact.places(term, rows):
        # words in common bound the subsequence: first those of the whole texts, then those of the stretches
        pairs, own = np.unique(rows[low].astype(np.int64) * len(block.words) + item, return_inverse=True)
        pair_row, pair_item = pairs // len(block.words), pairs % len(block.words)
        enough = row_stop[pair_row] - row_start[pair_row] > WHOLE
        short = np.flatnonzero(~enough)
        at = pair_row[short]
        enough[short] = exact.common(pair_item[short], row_start[at], row_stop[at], term) >= exact.least[pair_item[short]]
        item, low, high = (x[enough[own]] for x in (item, low, high))
        begin = np.maximum(row_start[rows[low]], high - exact.stretch[item] + 1)
        end = np.minimum(row_stop[rows[low]], low + exact.stretch[item])
        enough = exact.common(item, begin, end, term) >= exact.least[item]
        for k, first_word, last_word in zip(*(x[enough].tolist() for x in (item, low, high))):
            row = int(rows[first_word])
            if (row, k) not in found:
                n = covered(block, exact, k, hashes, term, row_start[row], row_stop[row], first_word, last_word)
                if n:
                    found[row, k] = n
    step = max(1, 8_000_000 // max(1, len(items)))
    for at in range(0, len(live), step):
        some = live[at : at + step]
        cosines = vectors[some] @ items.T
        cosines /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors[some], vectors[some])), 1e-12)[:, None]
        for w, item in zip(*np.divmod(np.flatnonzero(cosines >= COSINE), len(items))):
            window = some[w]
            row, words = int(rows[first[window]]), block.words[item]
            if (row, int(item)) in found:
                continue
            # the item may reach beyond the window on either side
            a = max(row_start[row], first[window] - len(words))
            b = min(row_stop[row], stop[window] + len(words))
            n = holds(words, block.answers[item], hashes[a:b])
            if n:
                found[row, int(item)] = n
    return [(row, item, n) for (row, item), n in found.items()]


def blocks_of(benchmark: DataFrame) -> Iterator[Block]:
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    held: list[tuple] = []
    rows = benchmark.select(F.struct("item_id").alias("item"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    # structs, because null ids are ids too
    for r in rows.groupBy("text", "answer").agg(F.collect_list("item").alias("items")).toLocalIterator():
        held.append(([item["item_id"] for item in r["items"]], r["text"] or "", r["answer"]))
        if len(held) == BLOCK_ITEMS:
            yield Block(*map(list, zip(*held)))
            held = []
    if held:
        yield Block(*map(list, zip(*held)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, lcs_words) of the items found in ``docs``."""
    spark = docs.sparkSession
    doc_type, item_type = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc_type}, item_id {item_type}, item_words int, lcs_words int"
    arrow_item = to_arrow_type(benchmark.schema["item_id"].dataType)
    texts = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))
    out = spark.createDataFrame([], schema)
    for block in blocks_of(benchmark):
        if not len(block.terms):
            continue
        z, df, passages = corpus_sketch(texts, block)
        basis = directions(block, z, df, passages)
        shared = spark.sparkContext.broadcast((block, basis, item_vectors(block, basis), Exact(block, df)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, basis, items, exact = shared.value
            for part in chunks(batches):
                found = [(row, item_id, item, n) for row, item, n in search(part.column("text"), block, basis, items, exact) for item_id in block.ids[item]]
                columns = [
                    part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([f[1] for f in found], arrow_item),
                    pa.array([len(block.words[f[2]]) for f in found], pa.int32()),
                    pa.array([f[3] for f in found], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "item_words", "lcs_words"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out
