"""Word vectors by skip-gram with negative sampling, trained side by side on parts of the texts.

1. Texts are stored and dealt into parts of about ``PART_BYTES``. Words are counted;
   a word's first vector is drawn from its hash, so that all parts start alike.
2. Each part is one pass over its own texts. A task holds one part: its texts and the
   vectors of the words in it. Every word predicts its neighbours within a window drawn
   from 1 to ``WINDOW``, against words drawn by their counts to the power of 0.75.
3. A word's vector is the mean of its vectors in the parts, weighed by its occurrences there.

A word has a vector in every part that it occurs in, which together are several times the texts. So
parts are trained a round at a time, at most ``ROUNDS`` rounds of at least as many parts as cores. After each round
the vectors of its parts are added to a table of one row a word, and the round's files go.

Vocabulary and vectors stay tables; the driver holds neither. Steps are scaled by the squared
gradients of each word so far, so a frequent word, which a chunk holds many times, moves no further than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.session import discard, shuffles_removed, stored, stored_path

PART_BYTES = 32_000_000
ROUNDS = 8
WINDOW = 5
# words predicted against for each neighbour, and drawn together for a chunk of words
NEGATIVES, DRAWN = 5, 64
WORDS_AT_ONCE, BLOCK = 1024, 16
RATE = 0.05
SEED = 1
# Fixed value: keeps the first steps small.
EPSILON = 1e-6


def start_vectors(hashes: np.ndarray, dim: int) -> np.ndarray:
    """A vector for each word hash, uniform between -0.5 and 0.5 over ``dim``."""
    z = hashes.view(np.uint64)[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) / dim).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _step(table: np.ndarray, seen: np.ndarray, ids: np.ndarray, gradient: np.ndarray) -> None:
    """One scaled step for each word among ``ids``, by the sum of its gradients."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    words, total = ids[heads], gradient[order[heads]]
    sizes = np.diff(np.append(heads, len(ids)))
    many = np.flatnonzero(sizes > 1)
    if len(many):
        at = np.repeat(heads[many] - (np.cumsum(sizes[many]) - sizes[many]), sizes[many]) + np.arange(sizes[many].sum())
        total[many] = np.add.reduceat(gradient[order[at]], np.cumsum(sizes[many]) - sizes[many], axis=0)
    seen[words] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    total *= (RATE / np.sqrt(seen[words] + EPSILON))[:, None]
    table[words] += total


def trained(ids: np.ndarray, owner: np.ndarray, counts: np.ndarray, vectors: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``vectors`` after one pass over the words ``ids`` of the texts ``owner``.

    Words are taken in blocks of ``BLOCK``, whose products with all words around the block are
    one small matrix product: too small for the threads of a matrix library, which would
    compete with those of the other tasks.
    """
    n, dim, wide = len(ids), vectors.shape[1], BLOCK + 2 * WINDOW
    out, seen = np.zeros_like(vectors), np.zeros((2, len(vectors)), np.float32)
    chances = np.cumsum(counts.astype(float) ** 0.75)
    # words of no text around all texts
    ends = (WINDOW, WINDOW + -n % BLOCK)
    reach = np.append(rng.integers(1, WINDOW + 1, n), np.zeros(-n % BLOCK, np.int64))
    ids, owner = np.pad(ids, ends), np.pad(owner, ends, constant_values=-1)
    distance = np.abs(np.arange(wide) - WINDOW - np.arange(BLOCK)[:, None])

    def around(rows: np.ndarray) -> np.ndarray:
        """The rows of each block and of the words around it."""
        return np.lib.stride_tricks.sliding_window_view(rows, wide, axis=0)[::BLOCK]

    for a in range(0, n, WORDS_AT_ONCE):
        size = min(WORDS_AT_ONCE, len(reach) - a)
        blocks, beside, middle = size // BLOCK, slice(a, a + size + 2 * WINDOW), slice(a + WINDOW, a + WINDOW + size)
        centre = vectors[ids[middle]].reshape(blocks, BLOCK, dim)
        # blocks x dimensions x words
        others = around(out[ids[beside]])
        near = (owner[middle].reshape(blocks, BLOCK, 1) == around(owner[beside])[:, None]) & (distance <= reach[a : a + size].reshape(blocks, BLOCK, 1)) & (distance > 0)
        pull = near * _sigmoid(-(centre @ others))
        own = (pull @ others.transpose(0, 2, 1)).reshape(size, dim)
        back = pull.transpose(0, 2, 1) @ centre
        total = np.zeros((blocks + 1, BLOCK, dim), np.float32)
        total[:-1] += back[:, :BLOCK]
        total[1:, : 2 * WINDOW] += back[:, BLOCK:]
        drawn = np.minimum(np.searchsorted(chances, rng.random(DRAWN) * chances[-1], side="right"), len(chances) - 1)
        noise = out[drawn]
        push = _sigmoid(centre @ noise.T) * (near.sum(axis=2, keepdims=True, dtype=np.float32) * np.float32(NEGATIVES / DRAWN))
        own -= (push @ noise).reshape(size, dim)
        pushed = (push.transpose(0, 2, 1) @ centre).sum(axis=0)
        _step(out, seen[1], np.append(ids[beside], drawn), np.concatenate([total.reshape(-1, dim)[: size + 2 * WINDOW], -pushed]))
        _step(vectors, seen[0], ids[middle], own)
    return vectors


def _part_vectors(dim: int):
    """Trains one part: its texts, and (part, word, hash, own, n) of its words."""

    def train(texts: pa.Table, words: pa.Table) -> pa.Table:
        known = words.column("word").combine_chunks()
        if not len(known):
            return pa.table({"word": pa.array([], pa.string()), "own": pa.array([], pa.int64()), "sum": pa.array([], pa.binary())})
        split = pc.split_pattern(texts.column("text").combine_chunks().cast(pa.large_string()), " ")
        ids = pc.index_in(split.flatten(), value_set=known.cast(pa.large_string()))
        owner = np.repeat(np.arange(len(split), dtype=np.int32), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        # words that are too rare are left out before neighbours are looked for
        kept = ids.is_valid().to_numpy(zero_copy_only=False)
        ids, owner = pc.fill_null(ids, 0).to_numpy()[kept], owner[kept]
        part = int(words.column("part")[0].as_py())
        vectors = start_vectors(words.column("hash").to_numpy(), dim)
        vectors = trained(ids, owner, words.column("n").to_numpy(), vectors, np.random.default_rng([SEED, part]))
        own = words.column("own").to_numpy()
        sums = vectors * own[:, None].astype(np.float32)
        return pa.table({"word": known, "own": pa.array(own), "sum": _sums(sums).cast(pa.binary())})

    return train


def _added(dim: int):
    """``word, own, sum`` by word from the rows of several parts, in order of their words."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def finished(word, own, total):
            return pa.RecordBatch.from_arrays([word, pa.array(own), _sums(total.astype(np.float32)).cast(pa.binary())], ["word", "own", "sum"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word, own = batch.column("word"), batch.column("own").to_numpy()
            total = _floats(batch.column("sum"), dim).astype(float)
            if held is not None:
                word, own, total = pa.concat_arrays([held[0], word]), np.append(held[1], own), np.concatenate([held[2], total])
            number = word.dictionary_encode().indices.to_numpy()
            heads = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            word, own, total = word.take(pa.array(heads)), np.add.reduceat(own, heads), np.add.reduceat(total, heads, axis=0)
            # the last word may go on in the next batch
            yield finished(word[:-1], own[:-1], total[:-1])
            held = word[-1:], own[-1:], total[-1:]
        if held is not None:
            yield finished(*held)

    return add


def _means(dim: int):
    """``word, vector`` from ``word, own, sum``."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            mean = (_floats(batch.column("sum"), dim) / own[:, None]).astype(np.float32)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dim), pa.array(mean.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), vector], ["word", "vector"])

    return divide


def _floats(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, dim)


def _sums(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of numbers."""
    ends = np.arange(len(rows) + 1, dtype=np.int64) * 4 * rows.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _round_size(parts: int, cores: int) -> int:
    """Parts that are trained before their vectors are added up: as many times the cores as it takes for ``ROUNDS`` rounds at most."""
    return min(parts, cores * -(-parts // (cores * ROUNDS)))


def word_vectors(texts: DataFrame, dim: int, text: str = "text", partitions: int | None = None, min_count: int = 5) -> DataFrame:
    """``word, vector`` of all words that occur ``min_count`` times or more.

    Words lie between single spaces. Null texts have none.
    """
    spark = texts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    place, known_at = stored_path(spark, "texts"), stored_path(spark, "words")
    numbered = texts.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    with shuffles_removed(spark):
        rows = stored(numbered, path=place, compression="zstd")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(partitions or cores, -(-size // PART_BYTES))
        known = rows.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        known = stored(known.where(F.col("n") >= min_count), path=known_at)
        # by the hash of the row's number, as equal texts would all go to one part by their own
        dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "text")
        total, total_at, wide = None, None, _round_size(parts, cores)
        for first in range(0, parts, wide):
            after = stored_path(spark, "sums")
            total = stored(_round(dealt, known, total, first, min(wide, parts - first), dim), path=after)
            if total_at:
                discard(spark, total_at)
            total_at = after
    for path in (place, known_at):
        discard(spark, path)
    return total.mapInArrow(_means(dim), "word string, vector array<float>")


def _round(dealt: DataFrame, known: DataFrame, total: DataFrame | None, first: int, wide: int, dim: int) -> DataFrame:
    """``word, own, sum`` of the parts from ``first`` on and of ``total``, the rounds before."""
    own = dealt.where(F.col("part").between(first, first + wide - 1))
    slot = (F.col("part") - first).alias("slot")
    counted = own.select("part", F.explode(F.split("text", " ")).alias("word")).groupBy("part", "word").agg(F.count(F.lit(1)).alias("own"))
    words = counted.join(known, "word").select(slot, "part", "word", F.xxhash64("word").alias("hash"), "own", "n").repartitionById(wide, "slot")
    sums = own.select(slot, "text").repartitionById(wide, "slot").groupBy("slot").cogroup(words.groupBy("slot")).applyInArrow(_part_vectors(dim), "word string, own bigint, sum binary")
    rows = sums if total is None else sums.unionByName(total)
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(_added(dim), "word string, own bigint, sum binary")
