"""Subword vocabulary: unigram language model fitted by expectation maximisation.

The word counts stay distributed. Only the vocabulary (pieces with log probabilities),
whose size is a parameter, is held by the driver and sent to the tasks.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.markers import WORD_START, reserved_symbols
from tarnmill.operators.repeats import maximal_repeats
from tarnmill.operators.subword import Segmenter, slices
from tarnmill.session import cut_lineage

# Default size, seeds per final piece, rounds and share kept per pruning.
VOCAB_SIZE = 50000
SEED_FACTOR = 4
EM_ROUNDS = 2
KEEP_SHARE = 0.75
MOST_PIECES = 1 << 21
# bytes of lines whose words are counted at once in a task
COUNTED_AT_ONCE = 16_000_000


def word_counts(files: DataFrame, lines: str = "lines", num_reserved: int = 0) -> DataFrame:
    """``word, n`` over all lines; words carry the word mark, reserved symbols are left out."""
    reserved = pa.array(reserved_symbols(num_reserved), pa.large_string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).flatten().cast(pa.large_string()).drop_null()
            for start, stop in slices(column, COUNTED_AT_ONCE):
                yield _slice_counts(column.slice(start, stop - start), reserved)

    counted = files.select(lines).mapInArrow(count, "w string, n bigint")
    return counted.groupBy(F.concat(F.lit(WORD_START), F.col("w")).alias("word")).agg(F.sum("n").alias("n"))


def _slice_counts(lines: pa.Array, reserved: pa.Array) -> pa.RecordBatch:
    """``w, n`` of some lines, in the NFKC form that encoding uses."""
    found = pc.ascii_split_whitespace(lines).flatten().value_counts()
    words, counts = found.field("values"), found.field("counts")
    kept = pc.invert(pc.is_in(words, reserved))
    words, counts = words.filter(kept), counts.filter(kept).to_numpy()
    # ASCII words are in that form
    plain = pc.string_is_ascii(words)
    others = [unicodedata.normalize("NFKC", word) for word in words.filter(pc.invert(plain)).to_pylist()]
    words = pc.replace_with_mask(words, pc.invert(plain), pa.array(others, pa.large_string()))
    parts = pc.ascii_split_whitespace(words)
    counts = np.repeat(counts, np.diff(parts.offsets.to_numpy()))
    filled = pc.not_equal(parts.flatten(), "")
    return pa.RecordBatch.from_arrays([parts.flatten().filter(filled).cast(pa.string()), pa.array(counts, pa.int64()).filter(filled)], ["w", "n"])


def seed_pieces(words: DataFrame, limit: int) -> DataFrame:
    """All single characters and the maximal repeats (of any length) with the highest count
    times length."""
    letters = words.select(F.explode(F.split("word", "")).alias("piece"), "n").where("piece <> ''")
    singles = cut_lineage(letters.groupBy("piece").agg(F.sum("n").alias("n")))
    longer = cut_lineage(maximal_repeats(words)).withColumn("gain", F.col("n") * F.length("piece"))
    # Exact counts per gain class (sixteen to each doubling) tell which classes can be
    # among the best, so that few more than ``limit`` rows are sorted.
    longer = longer.withColumn("class", F.floor(F.log2(F.col("gain").cast("double")) * 16).cast("int"))
    left = limit
    for row in longer.groupBy("class").count().orderBy(F.desc("class")).collect():
        floor, left = row["class"], left - row["count"]
        if left <= 0:
            longer = longer.where(F.col("class") >= floor).orderBy(F.desc("gain"), "piece").limit(limit)
            break
    return singles.unionByName(longer.select("piece", "n"))


def _piece_sums(words: DataFrame, measure) -> DataFrame:
    """``piece, c``: the sums of ``measure(segmenter, words, counts)`` over all words, by
    piece number; one row for each piece that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            counts = batch.column("n").to_numpy()
            for start, stop in slices(batch.column("word")):
                own = measure(batch.column("word").slice(start, stop - start), counts[start:stop])
                total = own if total is None else total + own
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "c"])

    partial = words.select("word", "n").mapInArrow(run, "piece bigint, c double")
    return partial.groupBy("piece").agg(F.sum("c").alias("c"))


def fit_vocabulary(
    words: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    num_reserved: int = 0,
    seed_factor: int = SEED_FACTOR,
    rounds: int = EM_ROUNDS,
    character_coverage: float = 1.0,
) -> DataFrame:
    """``piece, id, score`` with the reserved symbols first, then pieces by score.

    Alternates expectation steps (``rounds`` per size) with pruning of the pieces whose
    removal costs least, until ``vocab_size`` is reached. The most frequent single
    characters that make up ``character_coverage`` of the text always stay; rarer ones
    are left out with all pieces that hold them, and split words.
    """
    spark = words.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = cut_lineage(words.repartition(cores, "word"))
    wanted = vocab_size - len(reserved_symbols(num_reserved))
    if character_coverage < 1.0:
        words = cut_lineage(_covered(words, character_coverage))
    seeds = seed_pieces(words, seed_factor * vocab_size).collect()
    total = sum(row["n"] for row in seeds)
    scores = {row["piece"]: math.log(row["n"] / total) for row in seeds}
    while True:
        for _ in range(rounds):
            scores = _maximise(words, scores)
        if len(scores) <= wanted or all(len(p) == 1 for p in scores):
            break
        scores = _prune(words, scores, max(wanted, int(len(scores) * KEEP_SHARE)))
    fixed = [(piece, i, 0.0) for i, piece in enumerate(reserved_symbols(num_reserved))]
    ranked = sorted(scores.items(), key=lambda item: (-item[1], item[0]))
    learned = [(piece, len(fixed) + i, score) for i, (piece, score) in enumerate(ranked)]
    return spark.createDataFrame(fixed + learned, "piece string, id int, score double")


def _covered(words: DataFrame, coverage: float) -> DataFrame:
    """``words`` cut at the characters beyond the most frequent ``coverage`` of the text."""
    letters = words.select(F.explode(F.split("word", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    # one row for each character that occurs
    rows = sorted(letters.collect(), key=lambda row: (-row["n"], row["c"]))
    left, kept = coverage * sum(row["n"] for row in rows), []
    for row in rows:
        if left <= 0:
            break
        kept.append(row["c"])
        left -= row["n"]
    others = "".join(f"\\x{{{ord(c):x}}}" for c in kept)
    parts = words.select(F.explode(F.split("word", f"[^{others}]+")).alias("word"), "n").where("word <> ''")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _sums(words: DataFrame, segmenter: Segmenter, measure) -> np.ndarray:
    """The sums by piece number as one array of the vocabulary's size."""
    sent = words.sparkSession.sparkContext.broadcast(segmenter)
    table = _piece_sums(words, lambda some, counts: measure(sent.value, some, counts)).toArrow()
    sent.unpersist()
    sums = np.zeros(len(segmenter.pieces))
    sums[table.column("piece").to_numpy()] = table.column("c").to_numpy()
    return sums


def _maximise(words: DataFrame, scores: dict[str, float]) -> dict[str, float]:
    segmenter = Segmenter(scores)
    sums = _sums(words, segmenter, lambda own, some, counts: own.expected(some, counts))
    kept = {p: max(c, 0.5) for p, c in zip(segmenter.pieces, sums.tolist()) if c >= 0.5 or len(p) == 1}
    total = sum(kept.values())
    return {piece: math.log(count / total) for piece, count in kept.items()}


def _prune(words: DataFrame, scores: dict[str, float], size: int) -> dict[str, float]:
    """Keep the single characters and the pieces with the highest cost of removal: how
    often the best segmentations use a piece, times the score lost by writing it with
    other pieces."""
    segmenter = Segmenter(scores)
    used = _sums(words, segmenter, lambda own, some, counts: own.used(some, counts))
    lost = segmenter.loss()
    costs = dict(zip(segmenter.pieces, (used * lost).tolist()))
    singles = [piece for piece in scores if len(piece) == 1]
    longer = sorted((p for p in scores if len(p) > 1), key=lambda p: (-costs[p], p))
    kept = singles + longer[: max(0, size - len(singles))]
    return {piece: scores[piece] for piece in kept}


def piece_scores(vocab: DataFrame) -> dict[str, float]:
    """Learned pieces and their scores, for ``subword.encode_lines``.

    The table goes to every task, so one of more than ``MOST_PIECES`` rows is refused."""
    learned = vocab.where(F.col("score") < 0).select("piece", "score")
    rows = learned.limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"a vocabulary has at most {MOST_PIECES} pieces")
    return {row["piece"]: row["score"] for row in rows}
