"""Toxicity scores from the nearest labelled examples.

Fit: at most ``EXAMPLES`` labelled rows (those with the smallest id hashes) are the
examples. Every term of every example spans the vectors; document frequencies are counted
over all documents for all of them. A term weighs log(1 + count) times its inverse document
frequency, whatever its label. Examples become unit vectors in an inverted index. They are
ordered so that similar ones share a block of ``BLOCK``, and the index holds the largest weight of every
term in every block: dense rows for terms in a ``DENSE``-th of the examples or more, postings for the rest.

Score: the block maxima bound a text's cosines with each block. The postings' part of all cosines is added up term by
term, which costs less than block by block: they are few. Blocks are opened in falling order of
their bounds, in waves, and the dense rows' part added in them, until no unopened block can reach the text's ``NEIGHBOURS``-th cosine, so the neighbours found
are the exact nearest (ties: the smaller place). They vote with their cosine times the sum of what the
common terms add to it, each weighed by (1 + its log-likelihood ratio with the label) squared. The
share of toxic votes is calibrated by a monotone step function fitted on the examples,
each scored without itself. Texts without a term of the index get the rate of such examples.

Result per row: doc_id, held_out, score, predicted and evidence (the nearest three examples as
id:label:cosine). Null and empty texts have no terms. Rows with a null id are scored and
not held out; repeated rows and ids each get a row. Without labelled rows of both
classes all scores are the share of toxic labels (0.5 without labels). Null labels are passed over, and
an id with several labels counts with the largest. Labelled
copies of one text are one example, with the label of the smallest id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import ALNUM, bytes_of, chunks, mixed, span_hashes, staged, word_bounds

EXAMPLES = 8192
DENSE = 16
NEIGHBOURS = 48
FOLDS, HELD_OUT = 5, 0
# examples in a block, blocks opened first, signs that a vector is projected to when ordering
BLOCK, FIRST_BLOCKS, AXES = 128, 32, 48
# cosines this close count as equal when blocks are passed over
NEAR = 1e-8
# terms in a slice of the document frequencies, texts scored at once
SLICE, BATCH = 4096, 128


def expanded(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, members) of ranges, one range after the other."""
    sizes = ends - begins
    stops = np.cumsum(sizes)
    return sizes, np.arange(stops[-1] if len(stops) else 0) + np.repeat(begins - (stops - sizes), sizes)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, count) of the distinct terms of every row, rows ascending."""
    data, bounds = bytes_of(column)
    starts, stops, rows = word_bounds(data, bounds, ALNUM)
    hashes = span_hashes(data, starts, stops, lower=True)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))) if len(hashes) else np.zeros(0, int)
    return rows[fresh], hashes[fresh].astype(np.int64), np.diff(np.append(fresh, len(hashes)))


# ---------------------------------------------------------------- fitting


def examples_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored (doc_id, toxic, terms, n): each example with its distinct terms and their counts as 64-bit numbers."""
    known = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # copies of one text are one example
    texts = texts.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("text", "first.*").dropDuplicates(["doc_id"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows, hashes, n = term_counts(part.column("text"))
            cuts = np.searchsorted(rows, np.arange(len(part) + 1))
            lists = [pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for values in (hashes, n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "terms", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    return staged(texts.select("doc_id", "text", "toxic").mapInArrow(terms, f"doc_id {kind}, toxic int, terms binary, n binary"), "toxicity-examples")


def evidence_of(rows: np.ndarray, places: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Log-likelihood ratio between each term's presence and the label."""
    toxic, clean = labels.sum(), len(labels) - labels.sum()
    n = np.bincount(places, minlength=n_terms).astype(float)
    a = np.bincount(places, weights=labels[rows], minlength=n_terms)

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.where(observed > 0, observed, 1) / np.where(observed > 0, expected, 1))

    share, rest = toxic / len(labels), len(labels) - n
    ratio = part(a, n * share) + part(n - a, n * (1 - share)) + part(toxic - a, rest * share) + part(clean - n + a, rest * (1 - share))
    return np.maximum(2 * ratio, 0)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        seen = np.zeros(len(terms) + 1, np.int64)
        for part in chunks(batches):
            at = terms_in(part.column("text"), terms)[1]
            seen[:-1] += np.bincount(at, minlength=len(terms))
            seen[-1] += len(part)
        for number in range(0, len(seen), SLICE):
            some = seen[number : number + SLICE]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([number // SLICE], pa.int32()), pa.array([some.tobytes()], pa.binary())], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums[number] = sums.get(number, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n.tobytes() for n in sums.values()], pa.binary())], ["slice", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    kind = "slice int, n binary"
    found = np.zeros(len(terms) + 1, np.int64)
    for r in texts.mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).toLocalIterator():
        found[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], np.int64)
    return found[:-1], int(found[-1])


def terms_in(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of the term, count) of the index terms in every row."""
    data, bounds = bytes_of(column)
    starts, stops, rows = word_bounds(data, bounds, ALNUM)
    hashes = span_hashes(data, starts, stops, lower=True).astype(np.int64)
    # each distinct word is looked up once, and most words of a chunk are repeats
    words, which = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    at = np.where(terms[at] == words, at, -1)[which]
    hit = np.flatnonzero(at >= 0)
    pairs, n = np.unique(rows[hit].astype(np.int64) * len(terms) + at[hit], return_counts=True)
    return pairs // len(terms), pairs % len(terms), n


def neighbourly(rows: np.ndarray, places: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The examples in an order that puts similar ones next to each other: halves by the
    main direction of the vectors, projected to ``AXES`` signs, down to a block."""
    bits = mixed(places.astype(np.uint64))
    vectors = np.zeros((n, AXES))
    for axis in range(AXES):
        signs = ((bits >> np.uint64(axis)) & np.uint64(1)).astype(float) * 2 - 1
        vectors[:, axis] = np.bincount(rows, weights=weights * signs, minlength=n)
    order, done = [np.arange(n)], []
    while order:
        own = order.pop()
        if len(own) <= BLOCK:
            done.append(own)
            continue
        centred = vectors[own] - vectors[own].mean(axis=0)
        main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        own = own[np.argsort(centred @ main, kind="stable")]
        half = BLOCK * ((len(own) // BLOCK + 1) // 2)
        order += [own[half:], own[:half]]
    return np.concatenate(done)


class Index:
    """Unit vectors of the examples in blocks, with the largest weight of every term in every block.

    Terms in a ``DENSE``-th of the examples or more are dense rows, the others postings; both
    have their block maxima beside them.
    """

    def __init__(self, idf: np.ndarray, rows: np.ndarray, places: np.ndarray, counts: np.ndarray, labels: np.ndarray, ids: list, evidence: np.ndarray | None = None, order: np.ndarray | None = None):
        self.idf, self.labels, self.ids = idf, labels, ids
        slim = np.min_scalar_type(int(counts.max(initial=0)))
        self.made_from = (idf, rows.astype(np.int32), places.astype(np.int32), counts.astype(slim), labels, ids, evidence)
        evidence = np.ones(len(idf)) if evidence is None else evidence
        n, self.blocks = len(labels), -(-len(labels) // BLOCK)
        weights = np.log1p(counts) * idf[places]
        norms = np.sqrt(np.bincount(rows, weights=weights**2, minlength=n))
        weights = weights / norms[rows]
        # the vectors by example, for the votes
        self.own_cuts, self.own_places, self.own_votes = np.searchsorted(rows, np.arange(n + 1)), places.astype(np.int32), (weights * evidence[places]).astype(np.float32)
        self.order = neighbourly(rows, places, weights, n) if order is None else order
        spot = np.empty(n, np.int64)
        spot[self.order] = np.arange(n)
        self.spot, spots = spot, spot[rows]
        often = np.bincount(places, minlength=len(idf)) * DENSE >= n
        self.dense_row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.dense = np.zeros((int(often.sum()), self.blocks * BLOCK))
        thick = often[places]
        self.dense[self.dense_row[places[thick]], spots[thick]] = weights[thick]
        self.dense_most = self.dense.reshape(len(self.dense), self.blocks, BLOCK).max(axis=2)
        spots, places, weights = spots[~thick], places[~thick], weights[~thick]
        order = np.lexsort((spots, places))
        spots, places, self.weight = spots[order], places[order], weights[order]
        self.at = spots.astype(np.int32)
        # postings of one term within one block lie together and are an entry
        pair = places.astype(np.int64) * self.blocks + spots // BLOCK
        begins = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        self.entry_begin = np.append(begins, len(pair))
        self.entry_block = (pair[begins] % self.blocks).astype(np.int32)
        self.entry_most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        # the entries of a term lie between two neighbouring cuts
        self.cuts = np.searchsorted(places[begins], np.arange(len(idf) + 1))

    def __reduce__(self) -> tuple:
        # what is sent to the tasks is a fraction of the index; they build it again
        return Index, (*self.made_from, self.order)

    def unit(self, cuts: np.ndarray, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, weight) of every term of some texts whose terms lie between neighbouring cuts."""
        n = len(cuts) - 1
        text = np.repeat(np.arange(n), np.diff(cuts))
        query = np.log1p(counts) * self.idf[places]
        return text, query / np.sqrt(np.bincount(text, weights=query**2, minlength=n))[text]

    def search(self, text: np.ndarray, places: np.ndarray, query: np.ndarray, n: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosines by text and spot, opened by text and block, a lower bound of each text's k-th cosine): blocks are opened in falling order of
        their bounds, four times as many each time, until no bound reaches a text's k-th cosine. Spots of a block that stays
        closed hold the postings' part alone, which no bound exceeds."""
        at = self.dense_row[places]
        thick = at >= 0
        weights = np.zeros((n, len(self.dense)))
        weights[text[thick], at[thick]] = query[thick]
        text, places, query = text[~thick], places[~thick], query[~thick]
        bounds = weights @ self.dense_most
        out, opened = np.empty((n, self.blocks, BLOCK)), np.zeros(bounds.shape, bool)
        # one text at a time: its entries and sums stay in the processor's cache
        own_cuts = np.searchsorted(text, np.arange(n + 1)).tolist()
        for k in range(n):
            own = slice(own_cuts[k], own_cuts[k + 1])
            begin, end = self.cuts.take(places[own]), self.cuts.take(places[own] + 1)
            sizes, entry = expanded(begin, end)
            bounds[k] += np.bincount(self.entry_block.take(entry), weights=np.repeat(query[own], sizes) * self.entry_most.take(entry), minlength=self.blocks)
            sizes, post = expanded(self.entry_begin.take(begin), self.entry_begin.take(end))
            out[k] = np.bincount(self.at.take(post), weights=np.repeat(query[own], sizes) * self.weight.take(post), minlength=self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
        least, limit = np.zeros(n), FIRST_BLOCKS
        while True:
            wave = (rank < limit) & ~opened & (bounds > 0) & (bounds >= least[:, None] - NEAR)
            for b in np.flatnonzero(wave.any(axis=0)):
                own = np.flatnonzero(wave[:, b])
                out[own, b] += weights[own] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
            opened |= wave
            if without is not None:
                out.reshape(n, -1)[np.arange(n), self.spot[without]] = 0
            if limit >= self.blocks:
                return out.reshape(n, -1), opened, least
            if out[0].size > NEIGHBOURS:
                least = np.partition(out.reshape(n, -1), -NEIGHBOURS, axis=1)[:, -NEIGHBOURS]
            if not (~opened & (bounds > 0) & (bounds >= least[:, None] - NEAR)).any():
                return out.reshape(n, -1), opened, least
            limit *= 4

    def best(self, cosines: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the nearest examples with a cosine above 0; the k-th is ``least`` or more."""
        found = np.flatnonzero(cosines >= max(least - NEAR, 1e-300))
        if len(found) > NEIGHBOURS:
            least = np.partition(cosines[found], -NEIGHBOURS)[-NEIGHBOURS]
            found = found[cosines[found] >= least - NEAR]
        example, cosines = self.order[found], cosines[found]
        order = np.lexsort((example, -np.round(cosines, 9)))[:NEIGHBOURS]
        return example[order], np.minimum(cosines[order], 1.0)

    def nearest(self, places: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the exact nearest examples of one text."""
        found = self.nearest_of(np.array([0, len(places)]), places, counts, None if without < 0 else np.array([without]))
        return next(found)[:2]

    def nearest_of(self, cuts: np.ndarray, places: np.ndarray, counts: np.ndarray, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(nearest examples, their cosines, share of toxic votes) of each text whose terms lie between neighbouring cuts."""
        held = np.zeros(len(self.idf), np.float32)
        for at in range(0, len(cuts) - 1, BATCH):
            some = cuts[at : at + BATCH + 1]
            part = slice(some[0], some[-1])
            text, query = self.unit(some - some[0], places[part], counts[part])
            cosines, _, least = self.search(text, places[part], query, len(some) - 1, None if without is None else without[at : at + BATCH])
            for k, row in enumerate(cosines):
                found, near = self.best(row, float(least[k]))
                own = slice(some[k] - some[0], some[k + 1] - some[0])
                held[places[part][own]] = query[own]
                yield found, near, self.share(found, near, held)
                held[places[part][own]] = 0

    def share(self, found: np.ndarray, cosines: np.ndarray, query: np.ndarray) -> float:
        """Share of toxic votes: cosine squared, weighed by the evidence of what text and example have in common."""
        if not len(found):
            return 0.0
        own = [slice(a, b) for a, b in zip(self.own_cuts[found].tolist(), self.own_cuts[found + 1].tolist())]
        # the text's weights for the terms of all its neighbours are looked up at once
        met = query.take(np.concatenate([self.own_places[part] for part in own]))
        stops = np.cumsum([part.stop - part.start for part in own]).tolist()
        common = np.array([met[a:b] @ self.own_votes[part] for a, b, part in zip([0, *stops], stops, own)], float)
        votes = cosines * common
        return float((votes * self.labels[found]).sum() / votes.sum())


def monotone(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from, value) of the non-decreasing least-squares fit of labels by raw scores."""
    steps: list[list[float]] = []
    for value in np.unique(raw):
        own = labels[raw == value]
        steps.append([value, float(own.sum()), len(own)])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.5) / (s[2] + 1) for s in steps])


class Model:
    """What the scoring tasks need; its size is bounded by the texts of EXAMPLES rows."""

    def __init__(self, terms: np.ndarray, index: Index | None, bare: float):
        self.terms, self.index, self.bare = terms, index, bare
        self.froms, self.values = np.zeros(1), np.array([bare])

    def calibrate(self, rows: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        own = np.unique(rows)
        cuts = np.append(np.searchsorted(rows, own), len(rows))
        raw, labels = [], []
        for row, (found, _, share) in zip(own, self.index.nearest_of(cuts, places, counts, own)):
            if len(found):
                raw.append(share)
                labels.append(self.index.labels[row])
        if raw:
            self.froms, self.values = monotone(np.array(raw), np.array(labels))

    def score(self, found: np.ndarray, cosines: np.ndarray, raw: float) -> tuple[float, str]:
        """Score and evidence of a text with these nearest examples."""
        if not len(found):
            return self.bare, ""
        # a hair of the raw share keeps the order of rows within a step
        step = self.values[max(0, int(np.searchsorted(self.froms, raw, side="right")) - 1)]
        evidence = ",".join(f"{self.index.ids[e]}:{self.index.labels[e]}:{c:.4f}" for e, c in zip(found[:3], cosines[:3]))
        return float(min(1.0, max(0.0, step * 0.999 + raw * 0.001))), evidence


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    examples = sorted(examples_of(docs, labels).toLocalIterator(), key=lambda r: r["doc_id"])
    ids, y = [r["doc_id"] for r in examples], np.array([r["toxic"] for r in examples], np.int64)
    if y.sum() in (0, len(ids)):
        return Model(np.zeros(1, np.int64), None, float(y.mean()) if ids else 0.5)
    held = [np.frombuffer(r["terms"], np.int64) for r in examples]
    counts = np.concatenate([np.frombuffer(r["n"], np.int64) for r in examples])
    rows = np.repeat(np.arange(len(ids)), [len(h) for h in held])
    if not len(rows):
        return Model(np.zeros(1, np.int64), None, float(y.mean()))
    terms, places = np.unique(np.concatenate(held), return_inverse=True)
    # by place within a row, as the texts come
    order = np.lexsort((places, rows))
    places, counts = places[order], counts[order]
    df, n = document_frequencies(docs, terms)
    idf = np.log1p((n + 1) / (df + 1))
    bare = np.setdiff1d(np.arange(len(ids)), rows)
    model = Model(terms, Index(idf, rows, places, counts, y, ids, (1 + evidence_of(rows, places, y, len(terms))) ** 2), float((y[bare].sum() + 0.5) / (len(bare) + 1)))
    model.calibrate(rows, places, counts)
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        known: dict[bytes, tuple[float, str]] = {}
        for part in chunks(batches):
            score, evidence = np.full(len(part), model.bare), [""] * len(part)
            if model.index is not None:
                rows, places, counts = terms_in(part.column("text"), model.terms)
                own = np.unique(rows)
                cuts = np.append(np.searchsorted(rows, own), len(rows))
                # equal texts are scored once
                keys = [hashlib.blake2b(places[a:b].tobytes() + counts[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts, cuts[1:])]
                if len(known) >= 100_000:
                    known.clear()
                first = {key: k for k, key in enumerate(keys) if key not in known}
                new = np.array(list(first.values()), np.int64)
                if len(new):
                    sizes = np.diff(cuts)[new]
                    at = np.repeat(cuts[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    for key, near in zip(first, model.index.nearest_of(np.append(0, np.cumsum(sizes)), places[at], counts[at])):
                        known[key] = model.score(*near)
                for row, key in zip(own.tolist(), keys):
                    score[row], evidence[row] = known[key]
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence string")
