"""Text classifier: averaged embeddings of hashed word n-grams and a softmax, many settings at once.

A text is the mean of the embeddings of its words and word n-grams (hashed into ``buckets`` rows);
output weights and a softmax over the two classes give the label. Training is full-batch gradient descent
whose steps are scaled by the length of all gradients so far, for embeddings, weights and
bias each; a step for every single parameter would learn rare n-grams by heart. Every pass reads the stored features once, each task sums the
gradients of its rows for all settings and folds together, sums of tasks are added
in a tree (``TREE_WIDTH`` at a time, the last of them in the driver), and the new parameters go out for the next pass. Settings that
differ in their epochs alone are one run, looked at on the way. So there are as many
scans as epochs, whatever the number of settings, and the order of rows or partitions changes results
by rounding alone. Parameters have a fixed size (``buckets`` x dimensions), which bounds
what the driver holds.

The score of a text is linear in its mean features, so tasks get one weight for each bucket and setting
(embedding times output weights) and hand back one sum for each: the gradients of embeddings and output
weights are products of those sums with the parameters. A pass has at most as many tasks as cores, so what it
sends and shuffles depends on ``buckets``, settings, folds and cores, and not on the number of rows.

Settings with one n-gram length share their features, and their embeddings lie side by side in one matrix.
Features are stored once a text, as bucket numbers, whatever the number of folds that the text is in. A pass lays out the counts of ``_at_once`` texts as a matrix of texts by buckets for each n-gram length and
multiplies it by the weights of all settings and folds, and its transpose by their errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.arrays import let
from tarnmill.operators import grams
from tarnmill.session import stored

ROWS_AT_ONCE = 64
TREE_WIDTH = 16
# Up to so many buckets, the counts of some texts are laid out as a matrix of about so many cells.
MOST_BUCKETS, CELLS = 1 << 14, 1 << 20
SEED = 1
# Fixed value: keeps the first steps finite.
EPSILON = 1e-12


def features(text: Column, lengths: Sequence[int], buckets: int) -> Column:
    """Bucket numbers of the n-grams of a cleaned text, joined over the given lengths."""

    def numbered(gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")

    def hashed(words: Column) -> Column:
        def grams(n: int) -> Column:
            if n == 1:
                return F.transform(words, lambda word: numbered(word))
            heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
            return F.transform(heads, lambda word, i: numbered(F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, n)])))

        return F.concat(*[grams(n) for n in lengths])

    return let(F.filter(F.split(text, " +"), lambda w: w != ""), hashed)


class Scorer:
    """What a task needs of a block: weights by bucket and setting."""

    def __init__(self, block: Block):
        self.fold, self.word_ngrams, self.buckets, self.bias = block.fold, block.word_ngrams, block.buckets, block.bias.copy()
        weights = np.add.reduceat(block.table * block.out, block.cuts[:-1], axis=1)
        self.weights = np.ascontiguousarray(weights.T)

    def chances(self, lists: Sequence[pa.Array]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(probability of the positive class for each row and setting, row and bucket of every
        feature, features of each row); a row's features may lie in several lists."""
        rows, found, sizes = len(lists[0]), [], np.zeros(len(lists[0]), np.int64)
        sums = np.zeros((len(self.bias), rows))
        for column in lists:
            own = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            row, bucket = np.repeat(np.arange(rows), own), column.flatten().to_numpy()
            sizes += own
            found.append((row, bucket))
            for total, weights in zip(sums, self.weights):
                total += np.bincount(row, weights[bucket], rows)
        score = (sums / np.maximum(sizes, 1)).T + self.bias
        return 1.0 / (1.0 + np.exp(-score)), found, sizes

    def gradient(self, lists: Sequence[pa.Array], target: np.ndarray) -> list[np.ndarray]:
        """Errors summed over rows, times the mean features (settings x buckets), and alone."""
        chance, found, sizes = self.chances(lists)
        error = (chance - target[:, None]).T
        share = error / np.maximum(sizes, 1)
        totals = np.zeros(self.weights.shape)
        for row, bucket in found:
            for total, own in zip(totals, share):
                total += np.bincount(bucket, own[row], self.buckets)
        return [totals, error.sum(axis=1)]


class Grams:
    """The n-grams of one length of some texts: counts in a matrix, texts by buckets, or places where buckets are many.

    ``room`` keeps the arrays of a task from chunk to chunk, as fresh memory costs more than the counts do.
    """

    def __init__(self, chunk: pa.RecordBatch, n: int, buckets: int, room: dict):
        found = chunk.column(f"g{n}_{buckets}").cast(pa.binary())
        ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
        self.bucket = np.frombuffer(found.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(_number(buckets)).astype(np.int64)
        self.rows, self.buckets, self.sizes, self.room = len(found), buckets, np.diff(ends) // _number(buckets).itemsize, room
        self.row, self.matrix = np.repeat(np.arange(self.rows), self.sizes), None
        if buckets <= MOST_BUCKETS:
            cells = _room(room, n, _at_once(buckets) * buckets)
            self.places = self.row * buckets + self.bucket
            np.add.at(cells, self.places, 1.0)
            self.matrix = cells[: self.rows * buckets].reshape(self.rows, buckets)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """texts x runs, from runs x buckets"""
        if self.matrix is not None:
            return self.matrix @ weights.T
        return np.stack([np.bincount(self.row, own[self.bucket], self.rows) for own in weights], axis=1)

    def add(self, errors: np.ndarray, totals: np.ndarray) -> None:
        """Errors of texts x runs, summed by bucket, to totals of runs x buckets."""
        if self.matrix is not None:
            sums = _room(self.room, "sums", totals.size).reshape(totals.shape)
            totals += np.matmul(errors.T, self.matrix, out=sums)
        else:
            for total, own in zip(totals, errors.T):
                total += np.bincount(self.bucket, own[self.row], self.buckets)

    def close(self) -> None:
        """Leaves the matrix empty."""
        if self.matrix is not None:
            self.matrix.reshape(-1)[self.places] = 0.0


def _room(room: dict, name: int | str, size: int) -> np.ndarray:
    """Numbers kept under ``name``, zeros at first."""
    if name not in room or len(room[name]) < size:
        room[name] = np.zeros(size)
    return room[name][:size]


class Scorers:
    """What a task needs of all blocks with one number of buckets: weights by run and bucket, those of the longest n-grams first."""

    def __init__(self, numbered: Sequence[tuple[int, Block]]):
        numbered = sorted(numbered, key=lambda each: -each[1].word_ngrams)
        scorers = [Scorer(block) for _, block in numbered]
        runs = [len(scorer.bias) for scorer in scorers]
        self.blocks, self.cuts, self.buckets = [k for k, _ in numbered], np.append(0, np.cumsum(runs)), scorers[0].buckets
        self.weights = np.concatenate([scorer.weights for scorer in scorers])
        self.bias = np.concatenate([scorer.bias for scorer in scorers])
        self.fold = np.repeat([scorer.fold for scorer in scorers], runs)
        longest = np.repeat([scorer.word_ngrams for scorer in scorers], runs)
        # runs that use the n-grams of each length
        self.using = [int((longest >= n).sum()) for n in range(1, longest.max() + 1)]

    def chances(self, chunk: pa.RecordBatch, room: dict) -> tuple[np.ndarray, list[Grams], np.ndarray]:
        """(probability of the positive class, texts x runs; the n-grams of each length; features of each text and run)."""
        found = [Grams(chunk, n, self.buckets, room) for n in range(1, len(self.using) + 1)]
        sums, sizes = np.zeros((2, chunk.num_rows, len(self.bias)))
        for own, using in zip(found, self.using):
            sums[:, :using] += own.times(self.weights[:using])
            sizes[:, :using] += own.sizes[:, None]
        sizes = np.maximum(sizes, 1)
        return 1.0 / (1.0 + np.exp(-(sums / sizes + self.bias))), found, sizes

    def add(self, chunk: pa.RecordBatch, room: dict, totals: np.ndarray, more: np.ndarray) -> None:
        """Errors of the texts that a run's fold trains on, times their mean features (added to ``totals``,
        runs x buckets), and alone, and the number of these texts (``more``)."""
        chance, found, sizes = self.chances(chunk, room)
        members = self.members(chunk, "train")
        error = np.where(members, chance - chunk.column("target").to_numpy(zero_copy_only=False)[:, None], 0.0)
        share = error / sizes
        for own, using in zip(found, self.using):
            own.add(share[:, :using], totals[:using])
            own.close()
        more += error.sum(axis=0), members.sum(axis=0)

    def members(self, chunk: pa.RecordBatch, part: str) -> np.ndarray:
        """Whether a text is in this part of the fold of each run."""
        lists = chunk.column(part)
        row, fold = np.repeat(np.arange(chunk.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
        own = np.zeros((chunk.num_rows, self.fold.max() + 1), bool)
        known = fold <= self.fold.max()
        own[row[known], fold[known]] = True
        return own[:, self.fold]


def _scorers(blocks: Sequence[Block]) -> list[Scorers]:
    numbers = sorted({block.buckets for block in blocks})
    return [Scorers([(k, block) for k, block in enumerate(blocks) if block.buckets == buckets]) for buckets in numbers]


def _at_once(buckets: int) -> int:
    """Texts whose counts are laid out together."""
    return max(1, CELLS // buckets) if buckets <= MOST_BUCKETS else ROWS_AT_ONCE


def _number(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<i4")


def _raw(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column with ``sizes`` of the numbers in each row."""
    ends = np.append(0, np.cumsum(sizes * numbers.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(numbers)])


class Block:
    """The parameters of all settings of one fold that share an n-gram length."""

    def __init__(self, fold: int, word_ngrams: int, buckets: int, settings: Sequence[Mapping[str, float]], start: Mapping[int, np.ndarray] | None = None):
        self.fold, self.word_ngrams, self.buckets = fold, word_ngrams, buckets
        self.settings = [dict(s) for s in settings]
        dims = [int(s["dim"]) for s in self.settings]
        self.cuts = np.append(0, np.cumsum(dims))
        width = int(self.cuts[-1])
        self.table = np.empty((buckets, width))
        for k, dim in enumerate(dims):
            # equal for equal dimensions, whatever stands beside
            drawn = np.random.default_rng(SEED).uniform(-1.0 / dim, 1.0 / dim, (buckets, dim))
            for bucket, vector in (start or {}).items():
                if len(vector) == dim:
                    drawn[bucket] = vector
            self.table[:, self.cuts[k] : self.cuts[k + 1]] = drawn
        self.out = np.zeros(width)
        self.bias = np.zeros(len(dims))
        self.seen = np.zeros((3, len(dims)))
        # embedding column to setting
        self.owner = np.repeat(np.arange(len(dims)), dims)

    def step(self, sums: list[np.ndarray], n: int) -> None:
        """One update from the sums of ``Scorer.gradient`` over all rows."""
        # mean features times errors, for the setting of each embedding column
        wide = sums[0].T[:, self.owner]
        sums = [wide * self.out, (wide * self.table).sum(axis=0), sums[1]]
        for part, (value, total) in enumerate(zip((self.table, self.out, self.bias), sums)):
            mean = total / max(n, 1)
            # squared length of each setting's own part
            squares = mean**2 if part == 2 else np.add.reduceat((mean**2).sum(axis=0) if part == 0 else mean**2, self.cuts[:-1])
            self.seen[part] += squares
            scale = np.array([s["lr"] for s in self.settings]) / np.sqrt(self.seen[part] + EPSILON)
            value -= mean * (scale if part == 2 else scale[self.owner])


def _key(row: Mapping[str, float]) -> tuple[int, int]:
    return int(row["word_ngrams"]), int(row["buckets"])


def new_blocks(settings: Sequence[Mapping[str, float]], folds: Sequence[int], vectors: DataFrame | None = None) -> list[Block]:
    """One block for each fold and shape; settings that differ in their epochs share a place."""
    out = []
    for shape in sorted({_key(s) for s in settings}):
        start = start_vectors(vectors, shape[1])
        runs = sorted({(float(s["lr"]), int(s["dim"])) for s in settings if _key(s) == shape})
        out += [Block(fold, *shape, [{"lr": lr, "dim": dim} for lr, dim in runs], start) for fold in folds]
    return out


def placed(folds: DataFrame, num_folds: int) -> DataFrame:
    """One row a text, with the folds that train on it (``train``) and those that hold it out (``valid``), from
    such rows or from rows with ``fold`` and ``part``."""
    if "train" in folds.columns:
        return folds.withColumns({part: F.filter(part, lambda fold: fold < num_folds) for part in ("train", "valid")})
    none = F.array().cast("array<int>")
    held = {part: F.when(F.col("part") == part, F.array(F.col("fold").cast("int"))).otherwise(none) for part in ("train", "valid")}
    return folds.where(F.col("fold") < num_folds).withColumns(held)


def prepared(labelled: DataFrame, settings: Sequence[Mapping[str, float]], positive: str, keep: Sequence[str] = ()) -> DataFrame:
    """Stored ``train, valid, target`` and, for each n-gram length and number of buckets of the settings, the buckets
    of all n-grams as binary numbers; longer shapes share the n-grams of shorter ones."""
    shapes = [_key(s) for s in settings]
    longest = {buckets: max(n for n, own in shapes if own == buckets) for _, buckets in shapes}
    target = (F.col("label") == positive).cast("int").alias("target")
    rows = labelled.select("train", "valid", target, *keep, "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, ROWS_AT_ONCE):
            held = dict(zip(chunk.schema.names[:-1], chunk.columns[:-1]))
            for buckets, most in longest.items():
                for n, (sizes, bucket) in enumerate(grams.numbered(chunk.column("text"), range(1, most + 1), buckets), 1):
                    held[f"g{n}_{buckets}"] = _raw(bucket.astype(_number(buckets)), sizes)
            yield pa.RecordBatch.from_pydict(held)

    binary = [T.StructField(f"g{n}_{buckets}", T.BinaryType()) for buckets, most in longest.items() for n in range(1, most + 1)]
    return stored(rows.mapInArrow(pack, T.StructType([*rows.schema.fields[:-1], *binary])), "features")


def _at_most(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.coalesce(tasks) if rows.rdd.getNumPartitions() > tasks else rows


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(number: int, n: int, arrays: list[np.ndarray]) -> tuple:
    return number, n, b"".join(a.astype("<f8").tobytes() for a in arrays)


def _added(frame):
    """One row from the sums of several tasks for one block."""
    rows = frame.to_pydict()
    total = sum(np.frombuffer(raw, "<f8") for raw in rows["sums"])
    return pa.table({"block": [rows["block"][0]], "n": [sum(rows["n"])], "node": [rows["node"][0] // TREE_WIDTH], "sums": [total.tobytes()]})


def fit(train: DataFrame, blocks: list[Block], epochs: int) -> list[Block]:
    """The blocks after ``epochs`` more passes over the rows that their folds train on; ``train`` as ``prepared``."""
    context = train.sparkSession.sparkContext
    # every task hands back sums of the size of all weights
    rows = _at_most(train.where("size(train) > 0").drop("valid"), context.defaultParallelism)
    tasks = max(1, rows.rdd.getNumPartitions())
    for _ in range(epochs):
        sent = context.broadcast(_scorers(blocks))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, list] = {}
            rooms = [{} for _ in sent.value]
            held = [[np.zeros(each.weights.shape), np.zeros((2, len(each.bias)))] for each in sent.value]
            for batch in batches:
                for each, room, (totals, more) in zip(sent.value, rooms, held):
                    for chunk in _chunks([batch], _at_once(each.buckets)):
                        each.add(chunk, room, totals, more)
            for each, (totals, (errors, n)) in zip(sent.value, held):
                for k, a, b in zip(each.blocks, each.cuts[:-1], each.cuts[1:]):
                    if n[a]:
                        own[k] = [int(n[a]), [totals[a:b], errors[a:b]]]
            node = TaskContext.get().partitionId()
            for k, (n, gradient) in own.items():
                number, n, raw = _packed(k, n, gradient)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([node]), pa.array([raw], pa.binary())], ["block", "n", "node", "sums"])

        schema = "block bigint, n bigint, node bigint, sums binary"
        partial, width = rows.mapInArrow(sums, schema), tasks
        # so few rows of each block are added here
        while width > TREE_WIDTH:
            partial = partial.groupBy("block", F.floor(F.col("node") / TREE_WIDTH).alias("group")).applyInArrow(lambda table: _added(table), schema)
            width = -(-width // TREE_WIDTH)
        found: dict[int, list] = {}
        for row in sorted(partial.collect(), key=lambda row: row["node"]):
            n, total = found.get(row["block"], (0, 0.0))
            found[row["block"]] = n + row["n"], total + np.frombuffer(row["sums"], "<f8")
        for k, (n, total) in found.items():
            block = blocks[k]
            totals, errors = np.split(total, [len(block.bias) * block.buckets])
            block.step([totals.reshape(len(block.bias), block.buckets), errors], n)
        sent.unpersist()
    return blocks


def validated(rows: DataFrame, blocks: list[Block]) -> dict[tuple[int, tuple, float, int], float]:
    """Accuracy by (fold, shape, rate, dimension) over the validation rows, from one scan."""
    sent = rows.sparkSession.sparkContext.broadcast(_scorers(blocks))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rooms = [{} for _ in sent.value]
        counts = [np.zeros((2, len(each.bias)), np.int64) for each in sent.value]
        for batch in batches:
            for each, room, count in zip(sent.value, rooms, counts):
                for chunk in _chunks([batch], _at_once(each.buckets)):
                    chance, found, _ = each.chances(chunk, room)
                    members, target = each.members(chunk, "valid"), chunk.column("target").to_numpy(zero_copy_only=False)
                    count += (members & ((chance >= 0.5) == (target == 1)[:, None])).sum(axis=0), members.sum(axis=0)
                    for own in found:
                        own.close()
        rows = [
            (k, j - a, *map(int, count[:, j])) for each, count in zip(sent.value, counts) for k, a, b in zip(each.blocks, each.cuts[:-1], each.cuts[1:]) for j in range(a, b)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["block", "run", "good", "n"])

    partial = rows.where("size(valid) > 0").mapInArrow(judge, "block bigint, run bigint, good bigint, n bigint")
    out = {}
    # one row for each run of a fold
    for row in partial.groupBy("block", "run").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        block = blocks[row["block"]]
        run = block.settings[row["run"]]
        out[block.fold, (block.word_ngrams, block.buckets), run["lr"], run["dim"]] = row["good"] / row["n"] if row["n"] else 0.0
    sent.unpersist()
    return out


def predicted(rows: DataFrame, blocks: list[Block]) -> DataFrame:
    """``fold, label, chance`` of the validation rows, each by the block of its fold; blocks of one setting."""
    sent = rows.sparkSession.sparkContext.broadcast(_scorers(blocks)[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, room = sent.value, {}
        for chunk in _chunks(batches, _at_once(each.buckets)):
            chance, found, _ = each.chances(chunk, room)
            row, run = np.nonzero(each.members(chunk, "valid"))
            for own in found:
                own.close()
            yield pa.RecordBatch.from_arrays([pa.array(each.fold[run], pa.int32()), chunk.column("label").take(pa.array(row)), pa.array(chance[row, run])], ["fold", "label", "chance"])

    return rows.where("size(valid) > 0").mapInArrow(score, "fold int, label string, chance double")


class TextModel:
    """One fitted setting."""

    def __init__(self, block: Block):
        self.block = block

    def chance(self, comments: DataFrame, name: str) -> DataFrame:
        """``comments`` with the probability of the positive class of their cleaned ``text``."""
        block, lists = self.block, f"__features_{name}"
        sent = comments.sparkSession.sparkContext.broadcast(Scorer(block))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches):
                chance = sent.value.chances([chunk.column(lists)])[0][:, 0]
                yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], pa.array(chance)], [*chunk.schema.names[:-1], name])

        # a null text has no words
        found = features(F.coalesce(F.col("text"), F.lit("")), range(1, block.word_ngrams + 1), block.buckets)
        schema = T.StructType([*comments.schema.fields, T.StructField(name, T.DoubleType())])
        return comments.select("*", found.alias(lists)).mapInArrow(score, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each bucket, and one (bucket -1) for the output weights, the bias and the setting."""
        block = self.block
        last = [*block.out.tolist(), float(block.bias[0]), float(block.word_ngrams), float(block.buckets)]
        rows = [(k, row.tolist()) for k, row in enumerate(block.table)] + [(-1, last)]
        spark.createDataFrame(rows, "bucket int, vector array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        rows = {row["bucket"]: row["vector"] for row in spark.read.parquet(path).collect()}
        *out, bias, word_ngrams, buckets = rows[-1]
        block = Block(0, int(word_ngrams), int(buckets), [{"dim": len(out)}])
        block.table = np.array([rows[k] for k in range(int(buckets))])
        block.out, block.bias = np.array(out), np.array([bias])
        return cls(block)


def start_vectors(vectors: DataFrame | None, buckets: int) -> dict[int, np.ndarray]:
    """First embeddings by bucket from pre-trained vectors (``word, vector``); words that share a
    bucket give their mean. At most as many rows as buckets leave Spark."""
    if vectors is None:
        return {}
    hashed = vectors.select(F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("bucket"), F.posexplode("vector").alias("k", "x"))
    means = hashed.groupBy("bucket", "k").agg(F.avg("x").alias("x"))
    rows = means.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect()
    return {row["bucket"]: np.array([x for _, x in row["v"]]) for row in rows}
