"""Language-model scores by the likelihood of subword lattices.

The pieces of a published vocabulary (``piece_bpe_32k.model``) and the 256 single bytes span
the lattice of every word: each way to cut "word start + word" into pieces is a path. A word's
probability is the sum over all its paths of the product of the pieces' probabilities; a
text's is the product over its words, times that of the end. No piece crosses a word
start, so the lattice of a text falls apart into those of its words, and each distinct word is
summed once for the whole corpus.

1. ``lexicon``: the distinct words of all texts with their counts in training texts. A chunk
   of texts sends each of its words once, whatever its frequency.
2. ``trained``: the vocabulary's own scores give the first weights (its ranks, by Zipf's law);
   expectation-maximisation over all distinct training words with their counts fits them:
   forward and backward recursion in log space give every piece's expected count. Pieces never
   seen keep ``SMOOTHING`` counts. Only piece counts (a table of the vocabulary's size) are
   gathered between rounds.
3. ``scored``: forward recursion over every distinct word; the words' scores meet the chunks
   that hold them by one join, and each chunk sums them per text.

A trie walks all words of a batch at once; the recursion goes over positions, all words of the
batch together. Null texts count as empty and hold the end alone. Repeated rows and ids are
scored row by row. A row whose id is null has no remainder: it is neither held out nor
learned from. Without training texts the base score is null (0/0) and the pieces keep their first
weights. Other columns are not read, whatever their names. Very long texts are one chunk each;
a word of any length is summed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import _LOWER, NOT_SPACE, bytes_of, chunks, staged, word_bounds
from tarnmill.operators.trie import Trie

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 4
SMOOTHING = 0.1
FOLDS, HELD_OUT = 5, 1
# text bytes whose distinct words are sent together
BLOCK = 16_000_000
# word bytes whose lattices are summed together
BATCH = 400_000
START = "▁"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(the 256 bytes, then the pieces of a sentencepiece file; their first natural-log weights).

    Pieces with a word start inside cannot occur, and neither can those with white space.
    Scores that fall by one a piece are ranks: weight 1 / (rank + 1). Other scores are logs.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, scores = [], []
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
            name = model.id_to_piece(k)
            if START not in name[1:] and not set(name) & set(" \t\n\x0b\x0c\r"):
                names.append(name.encode())
                scores.append(model.get_score(k))
    pieces, logs = [bytes([b]) for b in range(256)], np.array(scores)
    ranks = bool(len(logs)) and bool(np.allclose(logs, np.round(logs)))
    weights = np.log(1.0 / (1.0 - np.maximum(logs, -1e6))) if ranks else logs
    known = {name: w for name, w in zip(names, weights.tolist())}
    least = float(weights.min()) if len(logs) else 0.0
    first = [known.pop(p, least) for p in pieces]
    return pieces + list(known), np.array(first + list(known.values()))


class Model:
    """Pieces with natural-log probabilities; the last one is that of the end."""

    def __init__(self, trie: Trie, logs: np.ndarray):
        self.trie, self.logs = trie, logs

    def lattice(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from, to, piece) between the places of the words, and the words' bounds.

        A word of n bytes (its start mark included) has n + 1 places.
        """
        marked = pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), words.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        data, bounds = bytes_of(marked)
        sizes = np.diff(bounds)
        word = np.repeat(np.arange(len(sizes)), sizes)
        start, end, piece = self.trie.matches(data, bounds[1:][word])
        own = word[start]
        return start + own, end + own, piece, bounds + np.arange(len(bounds))

    def forward(self, arcs, steps: np.ndarray, size: int, backward: bool = False) -> np.ndarray:
        """Log of the summed paths from the words' first places to each place (or to their last)."""
        source, target, piece, bounds = arcs
        if backward:
            source, target = target, source
        total = np.full(size, -np.inf)
        total[bounds[1:] - 1 if backward else bounds[:-1]] = 0.0
        # arcs by the step at which their target is due, then by target
        due = steps[target]
        order = np.lexsort((target, due))
        due, source, target, weight = due[order], source[order], target[order], self.logs[piece[order]]
        cuts = np.flatnonzero(np.append(True, due[1:] != due[:-1])) if len(due) else np.zeros(0, np.int64)
        heads = np.append(True, target[1:] != target[:-1]) if len(due) else np.zeros(0, bool)
        for low, high in zip(cuts, np.append(cuts[1:], len(due))):
            first = np.flatnonzero(heads[low:high])
            total[target[low:high][first]] = np.logaddexp.reduceat(total[source[low:high]] + weight[low:high], first)
        return total

    def words(self, words: pa.Array) -> np.ndarray:
        """Natural-log probability of each word."""
        arcs = self.lattice(words)
        bounds = arcs[3]
        size = int(bounds[-1])
        offsets = np.arange(size) - np.repeat(bounds[:-1], np.diff(bounds))
        return self.forward(arcs, offsets, size)[bounds[1:] - 1]

    def expected(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece in the words, each taken ``counts`` times."""
        arcs = self.lattice(words)
        source, target, piece, bounds = arcs
        size, lengths = int(bounds[-1]), np.diff(bounds)
        offsets = np.arange(size) - np.repeat(bounds[:-1], lengths)
        ahead = self.forward(arcs, offsets, size)
        behind = self.forward(arcs, np.repeat(lengths - 1, lengths) - offsets, size, backward=True)
        word = np.repeat(np.arange(len(lengths)), lengths)[source]
        share = np.exp(ahead[source] + self.logs[piece] + behind[target] - ahead[bounds[1:] - 1][word])
        return np.bincount(piece, weights=share * counts[word], minlength=len(self.logs))


def slices(words: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of the words with about ``BATCH`` bytes each."""
    total = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 4)
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH, side="right")))
        yield at, end
        at = end


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block of texts: the texts' ids and their words by number, the distinct words
    and their counts in training texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for chunk in joined(batches):
            data, bounds = bytes_of(chunk.column("text"))
            data = _LOWER[data].astype(np.uint8)
            starts, stops, rows = word_bounds(data, bounds, NOT_SPACE)
            sizes = stops - starts
            ends = np.append(0, np.cumsum(sizes))
            flat = data[NOT_SPACE[data]]
            words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
            coded = words.dictionary_encode()
            number = coded.indices.to_numpy()
            training = pc.fill_null(chunk.column("training"), False).to_numpy(zero_copy_only=False)
            counts = np.bincount(number[training[rows]], minlength=len(coded.dictionary)).astype(np.int64)
            per_text = np.bincount(rows, minlength=chunk.num_rows).astype(np.int64)
            whole = [chunk.column("doc_id"), chunk.column("held_out"), chunk.column("training"), pa.array(per_text), pa.array(number.astype(np.int32)), coded.dictionary.cast(pa.string()), pa.array(counts)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in whole]
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), *lists], ["block", "ids", "held_out", "training", "sizes", "numbers", "words", "counts"])
            n += 1

    schema = f"block bigint, ids array<{kind}>, held_out array<boolean>, training array<boolean>, sizes array<bigint>, numbers array<int>, words array<string>, counts array<bigint>"
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(remainder == HELD_OUT, F.lit(False)).alias("held_out"), F.coalesce(remainder != HELD_OUT, F.lit(False)).alias("training"))
    return rows.mapInArrow(build, schema)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches put together to about ``BLOCK`` text bytes."""
    held, size = [], 0
    for part in chunks(batches):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
        # rows without text take room as well
        size += 16 * part.num_rows
        if size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(part.num_rows for part in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def trained(words: DataFrame, n_texts: int, path: str, rounds: int = ROUNDS) -> Broadcast:
    """The model fitted to the stored table ``words`` (word, c), sent to the tasks."""
    context = words.sparkSession.sparkContext
    pieces, first = vocabulary(path)
    trie = Trie.of(pieces)
    logs = np.append(first, first.max())
    logs -= np.logaddexp.reduce(logs)
    sent = context.broadcast(Model(trie, logs))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        sums = np.zeros(len(model.logs))
        for batch in batches:
            column, counts = batch.column("word"), batch.column("c").to_numpy()
            for a, b in slices(column):
                sums += model.expected(column.slice(a, b - a), counts[a:b])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "n"])

    training = words.where("c > 0").select("word", "c")
    for _ in range(rounds if n_texts else 0):
        # one row for each piece of the vocabulary
        found = training.mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        sums = np.full(len(logs), SMOOTHING)
        sums[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        sums[-1] += n_texts
        old, sent = sent, context.broadcast(Model(trie, np.log(sums) - math.log(sums.sum())))
        old.unpersist()
    return sent


def scored(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score.

    Tokens are the words and one end. ``base_score`` sums the logs of smoothed relative
    frequencies, ``score`` is the log (base 10) of the text's probability. Texts whose
    crc32 of the id modulo 5 is not 1 are learned from.
    """
    kind = dict(docs.dtypes)["doc_id"]
    stored = staged(blocks(docs), "blocks")
    n_texts = stored.select(F.sum(F.aggregate("training", F.lit(0).cast("bigint"), lambda n, t: n + t.cast("bigint"))).alias("n")).head()["n"] or 0
    each = stored.select(F.explode(F.arrays_zip("words", "counts")).alias("at")).select("at.*")
    words = staged(each.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")), "words")
    known = words.where("c > 0").agg(F.count("c").alias("v"), F.sum("c").alias("n")).head()
    n_tokens = (known["n"] or 0) + n_texts
    distinct = known["v"] + (1 if n_texts else 0)
    sent = trained(words, n_texts, path or vocabulary_path(), rounds)
    end_score = float(sent.value.logs[-1]) / math.log(10)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            logs = [sent.value.words(column.slice(a, b - a)) for a, b in slices(column)]
            score = np.concatenate(logs) / math.log(10) if logs else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column, batch.column("c"), pa.array(score)], ["word", "c", "score"])

    lexicon = words.mapInArrow(spell, "word string, c bigint, score double")
    places = stored.select(F.col("block").alias("of"), F.posexplode("words").alias("number", "word"))
    found = places.join(lexicon, "word").select("of", "number", "c", "score")
    scale = math.log10(n_tokens + 0.5 * (distinct + 1)) if n_texts else None

    def total(key, texts, values):
        """The scores of one block's texts from those of its words."""
        row = texts.slice(0, 1)
        ids, held_out, sizes, numbers = (row.column(c).combine_chunks()[0].values for c in ("ids", "held_out", "sizes", "numbers"))
        number = values.column("number").to_numpy()
        c, score = np.zeros(len(number), np.int64), np.zeros(len(number))
        c[number], score[number] = values.column("c").to_numpy(), values.column("score").to_numpy()
        ends = np.cumsum(sizes.to_numpy())
        at = numbers.to_numpy()

        def per_text(of_words: np.ndarray) -> np.ndarray:
            text = np.repeat(np.arange(len(ends)), sizes.to_numpy())
            return np.bincount(text, weights=of_words[at], minlength=len(ends))

        base = pa.nulls(len(ends), pa.float64())
        if scale is not None:
            base = pa.array(per_text(np.log10(c + 0.5) - scale) + math.log10(n_texts + 0.5) - scale)
        arrays = [ids, held_out, pa.array(sizes.to_numpy() + 1), pa.array(per_text((c > 0).astype(float)).astype(np.int64) + (1 if n_texts else 0)), pa.array(np.full(len(ends), n_tokens, np.int64)), base, pa.array(per_text(score) + end_score)]
        return pa.table(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = stored.select("block", "ids", "held_out", "sizes", "numbers")
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(total, schema)
