"""Ranked lexical search, term at a time with a limited number of accumulators.

1. ``statistics``: one scan counts documents, terms and the document frequency of the query
   terms. Query terms are found by a hash and confirmed byte by byte.
2. ``segments``: the documents become an index. A segment holds the postings of about
   ``SEGMENT_DOCS`` documents, sorted by term, each with its part of the score that no
   weight changes; it is stored as one row of flat arrays.
3. ``searched``: each task keeps, for each item, the best documents of the segments it has seen.
   In a segment the item's terms are taken rarest first (largest weight). A document
   gets an accumulator at its first posting. Once the most that the terms still to come can add
   lies below the k-th best score so far (partial scores of this segment or full ones of earlier
   segments), no further document can enter, and no accumulator is made any more;
   those that exist go on to be updated, so their scores are exact.
4. The best of all tasks are ranked.

Items are handled in blocks of at most ``BLOCK_BYTES`` bytes of terms, which bounds what is sent
to the tasks; each block scans the documents again. An item alone is one block whatever its size.

Null texts have no terms. An item without terms, or whose terms no document holds, gets no
rows. Repeated rows and ids are ranked row by row; equal scores go by id, null ids last. Items
with equal ids are ranked as one item each, by their texts (rows with one id and one text are
one item). Other columns are not read, whatever their names. Very long texts are read whole;
memory grows with the longest single text. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import _LOWER, ALNUM, bytes_of, chunks, fresh, span_hashes, staged, word_bounds
from tarnmill.llm.ranking import first_rows

BEST = 50
SEGMENT_DOCS = 20_000
SEGMENT_POSTINGS = 3_000_000
BLOCK_BYTES = 8_000_000
# the terms of a text: letters and digits of ASCII and all other code points
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").translate(_ASCII)))


class Lexicon:
    """Query terms, by hash in rising order."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        hashes = span_hashes(data, ends[:-1], ends[1:])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.stops, self.data, self.order = hashes[order], ends[:-1][order], ends[1:][order], data, order
        # hashes that two terms share need both compared; at most so many neighbours share one
        runs = np.flatnonzero(np.append(True, self.hashes[1:] != self.hashes[:-1])) if len(raw) else np.zeros(0, np.int64)
        self.most = int(np.diff(np.append(runs, len(raw))).max()) if len(raw) else 0

    def find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of the term that each span of lower-case bytes is, or -1."""
        found = np.full(len(starts), -1, np.int64)
        hashes = span_hashes(data, starts, stops)
        first = np.searchsorted(self.hashes, hashes)
        for k in range(self.most):
            place = np.minimum(first + k, len(self.hashes) - 1)
            same = (self.hashes[place] == hashes) & (self.stops[place] - self.starts[place] == stops - starts)
            at = np.flatnonzero(same)
            for some in np.array_split(at, 1 + len(at) // 100_000):
                if len(some):
                    size = stops[some] - starts[some]
                    ends = np.append(0, np.cumsum(size))
                    step = np.arange(ends[-1])
                    own = data[np.repeat(starts[some] - ends[:-1], size) + step]
                    equal = np.logical_and.reduceat(own == self.data[np.repeat(self.starts[place[some]] - ends[:-1], size) + step], ends[:-1])
                    found[some[equal]] = self.order[place[some[equal]]]
        return found


def postings(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row with repeats, and the row, term and frequency of every posting)."""
    data, bounds = bytes_of(texts)
    data = _LOWER[data].astype(np.uint8)
    starts, stops, rows = word_bounds(data, bounds, ALNUM)
    sizes = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    term = lexicon.find(data, starts, stops)
    known = term >= 0
    key, tf = np.unique(rows[known] * max(len(lexicon.order), 1) + term[known], return_counts=True)
    width = max(len(lexicon.order), 1)
    return sizes, key // width, key % width, tf.astype(np.int64)


def statistics(docs: DataFrame, lexicon: Broadcast, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, document frequency of each query term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, documents, total = np.zeros(n_terms, np.int64), 0, 0
        for chunk in chunks(batches):
            sizes, _, term, _ = postings(chunk.column("text"), lexicon.value)
            frequency += np.bincount(term, minlength=n_terms)
            documents += int((sizes > 0).sum())
            total += int(sizes.sum())
        at = np.flatnonzero(frequency)
        keys = np.concatenate([[-1, -2], at])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([[documents, total], frequency[at]]))], ["term", "n"])

    # one row for each query term of the block
    sums = docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    frequency = np.zeros(n_terms, np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    return int(n[term == -1].sum()), int(n[term == -2].sum()), frequency


def segments(docs: DataFrame, lexicon: Broadcast, documents: int, total: int) -> DataFrame:
    """The index: per segment the ids, and term, document and value of its postings by term."""
    kind = dict(docs.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n_docs, n_postings = [], [], 0, 0

        def done() -> pa.RecordBatch:
            doc, term, value = (np.concatenate(columns) for columns in zip(*parts))
            order = np.lexsort((doc, term))
            arrays = [pa.concat_arrays(ids), pa.array(term[order].astype(np.int32)), pa.array(doc[order].astype(np.int32)), pa.array(value[order])]
            rows = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
            return pa.RecordBatch.from_arrays(rows, ["ids", "terms", "docs", "values"])

        for chunk in chunks(batches):
            sizes, row, term, tf = postings(chunk.column("text"), lexicon.value)
            length = 50 + (50 * sizes * documents) // max(total, 1)
            parts.append((row + n_docs, term, (1_000_000_000 * tf) // (1000 * tf + 20 * length[row])))
            ids.append(chunk.column("doc_id"))
            n_docs, n_postings = n_docs + chunk.num_rows, n_postings + len(row)
            if n_docs >= SEGMENT_DOCS or n_postings >= SEGMENT_POSTINGS:
                yield done()
                ids, parts, n_docs, n_postings = [], [], 0, 0
        if parts:
            yield done()

    return docs.mapInArrow(build, f"ids array<{kind}>, terms array<int>, docs array<int>, values array<bigint>")


def best_of(values: np.ndarray, k: int) -> int:
    """The k-th largest value, or 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def accumulate(terms: list[tuple[int, np.ndarray, np.ndarray, int]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, int]:
    """(scores of a segment's documents, accumulators made) for one item.

    ``terms``: weight, documents, values and largest value of each of the item's terms,
    rarest first. ``floor`` is a score that k documents are known to reach. Documents without
    an accumulator have score 0 and cannot be among the best k.
    """
    scores = np.zeros(n_docs, np.int64)
    rest = sum(weight * top for weight, _, _, top in terms)
    open_to_new, made = True, 0
    for weight, docs, values, top in terms:
        if open_to_new and made >= k and rest < int(scores.max()):
            floor = max(floor, best_of(scores[scores > 0], k))
        if rest < floor:
            open_to_new = False
        if not open_to_new:
            held = scores[docs] > 0
            docs, values = docs[held], values[held]
        else:
            made += int((scores[docs] == 0).sum())
        scores[docs] += weight * values
        rest -= weight * top
    return scores, made


def searched(index: DataFrame, items: Broadcast, kind: str, k: int) -> DataFrame:
    """(item, doc_id, score) of each task's k best documents of each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = items.value
        best_ids: list = [None] * len(queries)
        best_scores = [np.zeros(0, np.int64)] * len(queries)
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column("ids")[at].values
                term, docs, values = (batch.column(c)[at].values.to_numpy() for c in ("terms", "docs", "values"))
                present, first = np.unique(term, return_index=True)
                bounds = np.append(first, len(term))
                # lists of one term, made once for all items
                lists = {int(t): (docs[a:b], values[a:b], int(values[a:b].max())) for t, a, b in zip(present, bounds, bounds[1:])}
                # ties go by id, null ids last
                places = rank_of(ids)
                for q, weights in enumerate(queries):
                    own = [(w, *lists[t]) for t, w in weights if t in lists]
                    scores, _ = accumulate(own, len(ids), k, best_of(best_scores[q], k))
                    hit = np.flatnonzero(scores > 0)
                    if len(best_scores[q]) >= k:
                        hit = hit[scores[hit] >= best_of(best_scores[q], k)]
                    if len(hit) > k:
                        least = best_of(scores[hit], k)
                        hit = hit[scores[hit] >= least]
                        hit = hit[np.lexsort((places[hit], -scores[hit]))[:k]]
                    if len(hit):
                        merged = pa.concat_arrays([best_ids[q], ids.take(pa.array(hit))]) if best_ids[q] is not None else ids.take(pa.array(hit))
                        totals = np.concatenate([best_scores[q], scores[hit]])
                        keep = np.lexsort((rank_of(merged), -totals))[:k]
                        best_ids[q], best_scores[q] = merged.take(pa.array(keep)), totals[keep]
        for q, ids in enumerate(best_ids):
            if ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), ids, pa.array(best_scores[q])], ["item", "doc_id", "score"])

    return index.mapInArrow(search, f"item bigint, doc_id {kind}, score bigint")


def rank_of(ids: pa.Array) -> np.ndarray:
    """The place of every id in rising order, nulls last."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def blocks(items: Iterator) -> Iterator[list[tuple]]:
    """(item id, text, terms) in blocks of a bounded number of term bytes."""
    block, size = [], 0
    for item_id, text in items:
        terms = terms_of(text)
        own = sum(len(t.encode()) + 16 for t in terms)
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        if terms:
            block.append((item_id, text, terms))
            size += own
    if block:
        yield block


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of every benchmark item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"item_id {item_kind}, rank int, doc_id {kind}, score bigint"
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    results = []
    for block in blocks(items.toLocalIterator()):
        names = sorted(set().union(*(terms for _, _, terms in block)))
        number = {name: n for n, name in enumerate(names)}
        lexicon = spark.sparkContext.broadcast(Lexicon(names))
        documents, total, frequency = statistics(texts, lexicon, len(names))
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency]
        # rarest first
        queries = [sorted(((number[t], weight[number[t]]) for t in terms), key=lambda x: (-x[1], x[0])) for _, _, terms in block]
        index = staged(segments(texts, lexicon, documents, total), "segments")
        sent = spark.sparkContext.broadcast(queries)
        found = staged(searched(index, sent, kind, k), "found")
        ids = spark.createDataFrame([(n, item_id) for n, (item_id, _, _) in enumerate(block)], f"item bigint, item_id {item_kind}")
        place = fresh(found, "rank")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = first_rows(found, "item", order, k, F.struct("doc_id", "score"), place)
        # one row for each item of the block
        results.append(best.join(F.broadcast(ids), "item").select("item_id", F.col(place).alias("rank"), "doc_id", "score"))
        lexicon.unpersist()
        sent.unpersist()
    out = spark.createDataFrame([], schema)
    for result in results:
        out = out.union(result)
    return out
