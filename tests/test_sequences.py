"""Sequence construction on files whose places are known from how they are built."""

import random

import pytest
from pyspark.sql import functions as F

from tarnmill.markers import BEGIN_COMMENT, DEDENT, END_COMMENT, END_LINE, INDENT, MISSING
from tarnmill.operators import sequences
from tarnmill.operators.tokens import reserved_table

DEF = "▁def"


class Source:
    """A file built from nested functions, comments and lines, which knows its places."""

    def __init__(self, rng):
        self.rng, self.tokens = rng, ["<BOF>"]
        self.comments, self.line_stops, self.bodies = [], [], []
        for _ in range(rng.randint(0, 7)):
            self.item(0)
        self.tokens.append("<EOF>")

    def line(self, *tokens):
        self.tokens += [*tokens, END_LINE]
        self.line_stops.append(len(self.tokens))

    def item(self, depth):
        rng = self.rng
        kind = rng.random()
        words = rng.choices("uvwxyz", k=rng.randint(0, 5))
        if kind < 0.35 and depth < 3:
            self.line(DEF, "f", ":")
            start = len(self.tokens)
            self.tokens.append(INDENT)
            for _ in range(rng.randint(1, 4)):
                self.item(depth + 1)
            if depth == 0:
                self.bodies.append((start, len(self.tokens)))
            self.tokens.append(DEDENT)
        elif kind < 0.65:
            self.tokens += [BEGIN_COMMENT, *rng.choices("abc", k=rng.randint(0, 3)), END_COMMENT]
            self.comments.append(len(self.tokens) - 1)
            self.line(*words)
        else:
            self.line(*words)

    def target(self, cut, lines):
        following = [stop for stop in self.line_stops if stop > cut][:lines]
        return self.tokens[cut : following[-1]] if following else []

    def context(self, cut, most, fold):
        """The last ``most`` tokens; the fewest first functions that make the text fit
        have their bodies replaced by the marker."""
        whole = [body for body in self.bodies if body[1] < cut] if fold else []
        saved = [sum(b - a - 1 for a, b in whole[:k]) for k in range(len(whole) + 1)]
        folds = next((k for k, s in enumerate(saved) if cut - s <= most), len(whole))
        edges = [0, *[x for body in whole[:folds] for x in body], cut]
        shown = [self.tokens[a:b] for a, b in zip(edges[::2], edges[1::2])]
        text = [t for k, part in enumerate(shown) for t in ([MISSING] if k else []) + part]
        return text[-most:]

    def pairs(self, most, max_target, lines, fold):
        rows = []
        for number, at in enumerate(self.comments):
            target = self.target(at + 2, lines)
            if (0 < len(target)) if max_target == -1 else len(target) < max_target:
                rows.append((number, self.context(at + 2, most, fold), target))
        return rows


def found_pairs(df, *settings):
    found = {}
    for row in sequences.comment_pairs(df, *settings).collect():
        found.setdefault(row["file_id"], []).append((row["comment_no"], row["context"], row["target"]))
    return {i: sorted(rows) for i, rows in found.items()}


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("max_target, lines", [(80, 2), (6, 1), (-1, 3)])
def test_pairs_of_built_files(spark, monkeypatch, fold, max_target, lines):
    monkeypatch.setattr(sequences, "COMMENTS_AT_ONCE", 2)
    rng = random.Random(11)
    files = {i: Source(rng) for i in range(150)}
    df = spark.createDataFrame([(i, f.tokens) for i, f in files.items()], "file_id int, tokens array<string>")
    got = found_pairs(df, 12, max_target, lines, fold)
    for i, source in files.items():
        assert got.get(i, []) == source.pairs(12, max_target, lines, fold), source.tokens


def broken(rng):
    tokens = Source(rng).tokens[:-1]
    for _ in range(rng.randint(1, 6)):
        tokens.insert(rng.randint(0, len(tokens)), rng.choice([BEGIN_COMMENT, END_COMMENT, END_LINE, INDENT, DEDENT]))
    return tokens


@pytest.mark.parametrize("fold", [False, True])
def test_pairs_of_malformed_files(spark, fold):
    rng = random.Random(12)
    files = {i: broken(rng) for i in range(150)}
    df = spark.createDataFrame(list(files.items()), "file_id int, tokens array<string>")
    plain, got = found_pairs(df, 12, -1, 2, False), found_pairs(df, 12, -1, 2, fold)
    for i, rows in got.items():
        ends = [k for k, token in enumerate(files[i]) if token == END_COMMENT]
        # folding changes contexts only
        assert [(n, target) for n, _, target in rows] == [(n, target) for n, _, target in plain[i]]
        for number, context, target in rows:
            text = files[i][: ends[number] + 2]
            assert len(context) <= 12 and target and target[-1] == END_LINE and target.count(END_LINE) <= 2
            assert files[i][len(text) : len(text) + len(target)] == target
            if not fold or MISSING not in context:
                assert not fold or len(text) > 12 or context == text
            if not fold:
                assert context == text[-12:]


def test_function_blocks_of_built_files(spark):
    rng = random.Random(5)
    files = {i: Source(rng) for i in range(300)}
    df = spark.createDataFrame([(i, f.tokens) for i, f in files.items()], "file_id int, tokens array<string>")
    for row in df.select("file_id", sequences.function_blocks(F.col("tokens"), DEF).alias("b")).collect():
        assert [(b["body_start"], b["body_end"]) for b in row["b"]] == files[row["file_id"]].bodies


def test_comment_words_start_after_the_last_begin(spark):
    tokens = ["x", END_COMMENT, END_LINE, BEGIN_COMMENT, "a", END_COMMENT, "b", END_COMMENT, END_LINE]
    df = spark.createDataFrame([(1, tokens)], "file_id int, tokens array<string>")
    rows = sequences.comment_pairs(df).orderBy("comment_no").collect()
    assert [r["comment"] for r in rows] == [[], ["a"], ["a", END_COMMENT, "b"]]


def test_fold_cases(spark):
    body = [INDENT] + ["b"] * 9
    tokens = [DEF, "f", END_LINE, *body, DEDENT, "p", "q", BEGIN_COMMENT, "c", END_COMMENT, END_LINE, "t", END_LINE]
    df = spark.createDataFrame([(1, tokens)], "file_id int, tokens array<string>")
    end = tokens.index(END_COMMENT) + 2

    def context(limit):
        return sequences.comment_pairs(df, limit, fold_functions=True).first()["context"]

    assert context(end) == tokens[:end]
    folded = context(end - 5)
    assert folded == [DEF, "f", END_LINE, MISSING, *tokens[13:end]]
    assert context(4) == tokens[end - 4 : end]


def test_finetune_labels_and_padding(spark):
    vocab = reserved_table(spark).unionByName(spark.createDataFrame([("a", 100), ("b", 101)], "piece string, id int"))
    pairs = spark.createDataFrame(
        [(1, 0, ["a", "b"], ["a"]), (1, 1, ["b"], []), (2, 0, ["zzz"], ["b", "b", "a"])],
        "file_id int, comment_no int, context array<string>, target array<string>",
    )
    pairs = pairs.withColumn("comment", F.array().cast("array<string>"))
    examples = sequences.with_labels(sequences.finetune_examples(pairs, vocab))
    rows = {(r["file_id"], r["comment_no"]): r for r in examples.collect()}
    assert rows[1, 0]["ids"] == [100, 101, 100] and rows[1, 0]["labels"] == [-100, -100, 100]
    assert rows[1, 1]["ids"] == [101] and rows[1, 1]["labels"] == [-100]
    assert rows[2, 0]["ids"] == [0, 101, 101, 100]
    batches = sequences.padded_batches(examples, ["file_id", "comment_no"], 2)
    got = [(r["batch_id"], r["row"], r["input_ids"], r["labels"], r["attention_mask"]) for r in batches.orderBy("batch_id", "row").collect()]
    assert got == [
        (0, 0, [100, 101, 100], [-100, -100, 100], [1, 1, 1]),
        (0, 1, [3, 3, 101], [-100, -100, -100], [0, 0, 1]),
        (1, 0, [0, 101, 101, 100], [-100, 101, 101, 100], [1, 1, 1, 1]),
    ]
    right = sequences.padded_batches(examples, ["file_id", "comment_no"], 2, pad_left=False).where("row = 1").first()
    assert right["input_ids"] == [101, 3, 3] and right["attention_mask"] == [1, 0, 0]
