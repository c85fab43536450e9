"""Classifier, selection and classifier metrics."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnmill import session
from tarnmill.operators import classify, grams, skipgram, textmodel
from tarnmill.plans import comment_model
from tarnmill.sources import records

GOOD = ["create the file", "make sure the list is sorted", "update the index of words", "remove old entries"]
BAD = ["xxx fixme later", "todo not sure", "we hope this works", "magic do not touch"]


@pytest.fixture(scope="module")
def folds(spark):
    rng = random.Random(1)
    rows = []
    for fold in range(2):
        for part, n in (("train", 60), ("valid", 20)):
            rows += [(fold, part, "positive", rng.choice(GOOD)) for _ in range(n)]
            rows += [(fold, part, "negative", rng.choice(BAD)) for _ in range(n)]
    return spark.createDataFrame(rows, "fold int, part string, label string, text string").cache()


SMALL = {"buckets": 1 << 10, "epochs": 12}


def test_predict(spark, folds):
    model = classify.fit_classifier(folds.where("part = 'train'"), SMALL)
    comments = spark.createDataFrame([(0, "Create the (file)."), (1, "XXX fixme later"), (2, "")], "block_no int, text string")
    rows = classify.predict(model, comments).orderBy("block_no").collect()
    assert [r["label"] for r in rows] == ["positive", "negative", "NA"]
    assert rows[0]["text"] == "Create the (file)." and rows[2]["prob"] == 0.0
    assert all(r["prob"] >= 0.5 for r in rows[:2])


def test_start_from_vectors(folds):
    vectors = records.vector_table(classify.word_vectors(folds.select("text"), 10, partitions=2, min_count=1))
    assert vectors.select(F.size("vector")).distinct().collect()[0][0] == 10
    start = textmodel.start_vectors(vectors, 1 << 10)
    block = textmodel.new_blocks([{**classify.DEFAULTS, **SMALL}], [0], vectors)[0]
    assert start and all((block.table[k] == v).all() for k, v in start.items())
    model = classify.fit_classifier(folds.where("part = 'train'"), SMALL, vectors)
    predicted = classify.predict(model, folds.where("part = 'valid'").withColumnRenamed("label", "truth"), clean=False)
    assert predicted.where("label = truth").count() == 80


def test_grid_search_and_report(spark, folds, tmp_path):
    grid = {"word_ngrams": [1, 2], "lr": [3.0], "buckets": [1 << 10], "epochs": [4, 8]}
    results = classify.grid_search(folds, 2, grid)
    assert results.count() == 4 and classify.best_setting(results).first()["setting"] == 0
    model = comment_model.search_classifier(folds, 2, str(tmp_path), grid)
    report = comment_model.evaluate_classifier(model, folds.where("part = 'valid'").select("label", "text"), str(tmp_path)).first()
    assert report["total"] == 80 and report["accuracy"] == 1.0 and report["auc"] == 1.0
    written = spark.read.option("header", True).csv(str(tmp_path / "predictions"))
    assert written.columns == ["entry", "label", "predicted_label", "correct", "probability"]
    again = textmodel.TextModel.load(spark, str(tmp_path / "model"))
    rows = folds.where("part = 'valid'").select("text")
    assert sorted(map(tuple, classify.predict(again, rows).collect())) == sorted(map(tuple, classify.predict(model, rows).collect()))


def noisy(spark, seed, n=700):
    """Comments of the shape of the shipped folds: 65 % negative, 1 to 20 words, labels that
    follow some words most of the time."""
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(400)]
    rows = []
    for fold in range(2):
        for k in range(n):
            label = "positive" if rng.random() < 0.35 else "negative"
            own = [f"{label[:3]}{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 2]))]
            words = own + [rng.choice(common) for _ in range(rng.randint(1, 18))]
            rng.shuffle(words)
            rows.append((fold, "valid" if k % 5 == 0 else "train", label, " ".join(words)))
    return spark.createDataFrame(rows, "fold int, part string, label string, text string")


def test_accuracy_beats_the_larger_class_and_partitions_do_not_matter(spark):
    rows = noisy(spark, 5)
    params = {**classify.DEFAULTS, "buckets": 1 << 11}
    few = classify.predict_folds(rows.repartition(4), params, 2)
    assert classify.mean_accuracy(few).first()[0] > 0.72
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        models = [classify.fit_classifier(rows.where("fold = 0 and part = 'train'").repartition(n), params).block for n in (4, 64)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert np.abs(models[0].table - models[1].table).max() < 1e-6 and np.abs(models[0].out - models[1].out).max() < 1e-6


def test_every_row_of_the_grid_equals_a_single_fit(spark):
    rows = noisy(spark, 6, 200)
    grid = {"word_ngrams": [1, 2], "buckets": [1 << 9], "dim": [3, 5], "lr": [0.5, 3.0], "epochs": [2, 6]}
    results = classify.grid_search(rows, 2, grid).collect()
    assert len(results) == 16
    for row in results[::5]:
        params = {name: row[name] for name in grid}
        alone = classify.mean_accuracy(classify.predict_folds(rows, params, 2)).first()[0]
        assert abs(row["avg_accuracy"] - alone) < 1e-9


def test_lines_of_files_are_scored(spark, folds):
    """Texts that come out of arrays of lines, as in a corpus."""
    model = classify.fit_classifier(folds.where("part = 'train'"), SMALL)
    files = spark.createDataFrame([("a", ["remove old entries", ""]), ("b", ["todo not sure", None])], "file_id string, lines array<string>")
    lines = files.select("file_id", F.posexplode("lines").alias("block_no", "text"))
    rows = classify.predict(model, lines).select("file_id", "block_no", "label", "prob").orderBy("file_id", "block_no").collect()
    assert [r["label"] for r in rows[:3]] == ["positive", "NA", "negative"] and len(rows) == 4


def test_sums_of_a_task_have_no_dimensions(spark, folds):
    """A task gets and returns one number for each bucket and setting, and a step from these sums
    equals one from gradients of all embeddings."""
    settings = [{"word_ngrams": 2, "buckets": 32, "dim": dim, "lr": 3.0} for dim in (4, 6)]
    rows = spark.createDataFrame([("a b c",), ("",), ("b b",)], "text string")
    lists = rows.select(*[textmodel.features(F.col("text"), [n], 32).alias(f"g{n}") for n in (1, 2)]).toArrow()
    lists, target = [lists[c].combine_chunks() for c in ("g1", "g2")], np.array([1, 0, 0])
    block = textmodel.new_blocks(settings, [0])[0]
    block.out = np.linspace(-1.0, 1.0, 10)
    x = np.zeros((3, 32))
    for column in lists:
        for k, found in enumerate(column.to_pylist()):
            for bucket in found:
                x[k, bucket] += 1
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    assert (x.sum(axis=1) == [1, 0, 1]).all()
    mean = x @ block.table
    error = 1 / (1 + np.exp(-np.add.reduceat(mean * block.out, [0, 4], axis=1))) - target[:, None]
    totals, errors = textmodel.Scorer(block).gradient(lists, target)
    assert totals.shape == (2, 32) and np.allclose(totals, (x.T @ error).T) and np.allclose(errors, error.sum(axis=0))
    wide = error[:, block.owner]
    table, out = x.T @ (wide * block.out) / 3, (mean * wide).sum(axis=0) / 3
    scale = [3.0 / np.sqrt(np.add.reduceat(s, [0, 4]) + textmodel.EPSILON)[block.owner] for s in ((table**2).sum(axis=0), out**2)]
    want = block.table - table * scale[0], block.out - out * scale[1]
    block.step([totals, errors], 3)
    assert np.allclose(block.table, want[0]) and np.allclose(block.out, want[1])


def test_grams_equal_the_features_of_built_in_functions(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c  d\u00e9\u6f22 z") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)]
    texts += ["", " ", " x  y ", "q" * 31, "q" * 32, "q" * 33 + " r", "w" * 64 + " " + "w" * 100, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    for buckets in (97, 1 << 12, 1 << 18):
        lists = [textmodel.features(F.coalesce("text", F.lit("")), [n], buckets) for n in (1, 2, 3)]
        want = rows.select("k", *lists).orderBy("k").collect()
        for n, (sizes, found) in enumerate(grams.numbered(pa.array(["left out", *texts])[1:], (1, 2, 3), buckets), 1):
            assert [own.tolist() for own in np.split(found, np.cumsum(sizes)[:-1])] == [r[n] for r in want]


@pytest.mark.parametrize("buckets", [1 << 9, 1 << 15])
def test_a_pass_over_all_folds_equals_the_sums_of_each(spark, monkeypatch, buckets):
    """One row a text, whatever its folds, multiplied by the weights of all settings and folds at once."""
    monkeypatch.setattr(textmodel, "CELLS", 1 << 13)
    settings = [{"word_ngrams": n, "buckets": buckets, "dim": 3, "lr": lr} for n in (1, 2) for lr in (1.0, 3.0)]
    rng = random.Random(3)
    texts = [(k, rng.choice(["positive", "negative"]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9)))) for k in range(90)]
    folds = spark.createDataFrame([(*t, [f for f in (0, 1) if t[0] % 4 != f], [f for f in (0, 1) if t[0] % 4 == f]) for t in texts], "k int, label string, text string, train array<int>, valid array<int>")
    flat = folds.select("label", "text", F.explode("train").alias("fold"), F.lit("train").alias("part")).union(folds.select("label", "text", F.explode("valid"), F.lit("valid")))
    rows = textmodel.prepared(textmodel.placed(folds, 2), settings, "positive")
    assert rows.count() == 90 and textmodel.prepared(textmodel.placed(flat, 1), settings, "positive").count() == 90
    blocks = textmodel.new_blocks(settings, range(2))
    for block in blocks:
        block.out += np.linspace(-1.0, 1.0, len(block.out))
    [each] = textmodel._scorers(blocks)
    room, totals, more = {}, np.zeros(each.weights.shape), np.zeros((2, len(each.bias)))
    for batch in rows.toArrow().to_batches():
        for chunk in textmodel._chunks([batch], textmodel._at_once(buckets)):
            each.add(chunk, room, totals, more)
    for k, a, b in zip(each.blocks, each.cuts[:-1], each.cuts[1:]):
        own = folds.where(F.array_contains("train", blocks[k].fold))
        lists = own.select(*[textmodel.features(F.col("text"), [n], buckets).alias(f"g{n}") for n in range(1, blocks[k].word_ngrams + 1)]).toArrow()
        target = np.array([int(r["label"] == "positive") for r in own.select("label").collect()])
        want = textmodel.Scorer(blocks[k]).gradient([c.combine_chunks() for c in lists.columns], target)
        assert np.allclose(totals[a:b], want[0]) and np.allclose(more[0, a:b], want[1]) and (more[1, a:b] == len(target)).all()
    one, other = (classify.grid_search(each, 2, {"word_ngrams": [1, 2], "buckets": [buckets], "lr": [1.0, 3.0], "epochs": [2, 3], "dim": [3]}).collect() for each in (folds, flat))
    assert [r["avg_accuracy"] for r in one] == pytest.approx([r["avg_accuracy"] for r in other], abs=1e-9) and len(one) == 8


def test_a_pass_has_at_most_as_many_sums_as_cores(spark):
    rows = spark.range(0, 1000, 1, 50)
    assert textmodel._at_most(rows, 4).rdd.getNumPartitions() == 4 and textmodel._at_most(rows, 64).rdd.getNumPartitions() == 50


def test_best_setting_keeps_the_first(spark):
    results = spark.createDataFrame([(0, 0.5), (1, 0.8), (2, 0.8)], "setting int, avg_accuracy double")
    assert classify.best_setting(results).first()["setting"] == 1


PREDICTED = [
    ("positive", "positive", 0.9),
    ("positive", "negative", 0.6),
    ("negative", "negative", 0.8),
    ("negative", "positive", 0.7),
    ("positive", "positive", 0.9),
    ("negative", "positive", 0.9),
]


def predictions(spark, rows=PREDICTED):
    return spark.createDataFrame(rows, "label string, predicted_label string, prob double")


def test_confusion_metrics(spark):
    row = classify.confusion_metrics(predictions(spark)).first()
    assert (row["true_positive"], row["true_negative"], row["false_positive"], row["false_negative"]) == (2, 1, 2, 1)
    assert row["accuracy"] == 0.5 and row["precision"] == 0.5 and abs(row["recall"] - 2 / 3) < 1e-12
    none = classify.confusion_metrics(predictions(spark, [("negative", "negative", 0.6)])).first()
    assert none["precision"] is None and none["f1"] is None and none["accuracy"] == 1.0


def test_auc_counts_pairs(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        score = rng.randint(0, 20) / 20
        rows.append((rng.choice(["positive", "negative"]), "positive" if score >= 0.5 else "negative", max(score, 1 - score)))
    scored = [(a, p if b == "positive" else 1 - p) for a, b, p in rows]
    up = [round(s, 9) for a, s in scored if a == "positive"]
    down = [round(s, 9) for a, s in scored if a == "negative"]
    wins = sum((u > d) + 0.5 * (u == d) for u in up for d in down)
    assert abs(classify.roc_auc(predictions(spark, rows)).first()[0] - wins / len(up) / len(down)) < 1e-9
    curve = classify.roc_curve(predictions(spark, rows)).orderBy("fpr", "tpr").collect()
    assert curve[-1]["fpr"] == curve[-1]["tpr"] == 1.0


def test_selection(spark):
    scored = spark.createDataFrame(
        [("a", 1, "positive", 0.74996), ("a", 0, "negative", 0.99), ("b", 0, "positive", 0.7), ("c", 0, "positive", 0.8)],
        "file_id string, block_no int, label string, prob double",
    )
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file_id string")
    assert sorted(r[0] for r in classify.suitable_files(files, scored, 0.75).collect()) == ["a", "c"]
    gathered = classify.gather_predictions(scored)
    flags = {r["file_id"]: r["s"] for r in gathered.select("file_id", classify.is_suitable_file(F.col("predictions"), 0.75).alias("s")).collect()}
    assert flags == {"a": True, "b": False, "c": True}
    assert gathered.where("file_id = 'a'").first()["predictions"][0]["label"] == "negative"
    assert classify.suitable_comments(scored, 0.75).count() == 1


def test_grid_results_runs_every_setting(monkeypatch):
    from checks import classifier

    monkeypatch.setattr(classifier, "_labelled", lambda spark, sf: None)
    asked = []
    monkeypatch.setattr(classify, "grid_search", lambda folds, num_folds, grid=classify.GRID: asked.append((num_folds, grid)))
    classifier.grid_results(None, "")
    assert asked == [(3, classify.GRID)]


def test_word_vectors_stay_tables(spark):
    """Words with the same neighbours lie close, every word of the vocabulary has one row,
    whatever the number of parts, and the driver holds no model."""
    rng = random.Random(5)
    groups = [[f"{name}{k}" for k in range(6)] for name in "abcd"]
    rows = [(" ".join(rng.choice(groups[k % 4]) for _ in range(12)),) for k in range(4000)]
    texts = spark.createDataFrame([*rows, ("rare",), (None,)], "text string")
    for parts in (1, 3):
        found = classify.word_vectors(texts, 16, partitions=parts)
        assert isinstance(found, type(texts)) and dict(found.dtypes) == {"word": "string", "vector": "array<float>"}
        vectors = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in found.collect()}
        assert sorted(vectors) == sorted(word for group in groups for word in group)
        inner = [vectors[a] @ vectors[b] for group in groups for a in group for b in group if a < b]
        outer = [vectors[a] @ vectors[b] for g in groups for h in groups if g < h for a in g for b in h]
        assert min(inner) > max(outer)


def test_vectors_of_parts_are_added_up_in_rounds(spark, monkeypatch, tmp_path):
    """What is stored between rounds has one row a word, not one for each part and word, and the texts go."""
    rng = random.Random(7)
    groups = [[f"{name}{k}" for k in range(6)] for name in "abc"]
    texts = spark.createDataFrame([(" ".join(rng.choice(groups[k % 3]) for _ in range(12)),) for k in range(15000)], "text string")
    cores, tables = spark.sparkContext.defaultParallelism, []
    assert [skipgram._round_size(parts, 8) for parts in (1, 8, 9, 64, 65, 330)] == [1, 8, 8, 8, 16, 48]

    def counting(df, name="table", path=None, **options):
        table = session.stored(df, name, path, **options)
        tables.append((path or name, table.agg(F.count(F.lit(1)), F.sum(table["own"] if "own" in table.columns else F.lit(0))).first()))
        return table

    monkeypatch.setattr(skipgram, "stored", counting)
    found = classify.word_vectors(texts, 16, partitions=3 * cores - 1)
    sums = [tuple(row) for path, row in tables if path.endswith("/sums")]
    assert len(sums) == 3 and sums[-1] == (18, 15000 * 12) and [rows for rows, _ in sums] == [18] * 3
    assert [os.path.exists(path.removeprefix("file:")) for path, _ in tables] == [False] * (len(tables) - 1) + [True]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    vectors = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in found.collect()}
    inner = [vectors[a] @ vectors[b] for group in groups for a in group for b in group if a < b]
    outer = [vectors[a] @ vectors[b] for g in groups for h in groups if g < h for a in g for b in h]
    assert len(vectors) == 18 and min(inner) > max(outer)


def test_sums_of_a_word_lie_in_any_batches():
    rng = np.random.default_rng(2)
    words = sorted(f"w{k}" for k in rng.integers(0, 9, 60))
    own, sums = rng.integers(1, 9, 60), rng.random((60, 4)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(words), pa.array(own), skipgram._sums(sums).cast(pa.binary())], ["word", "own", "sum"])
    for step in (1, 7, 60):
        got = pa.Table.from_batches(skipgram._added(4)(rows.slice(k, step) for k in range(0, 60, step)))
        assert got.column("word").to_pylist() == sorted(set(words))
        for word, n, vector in zip(*(got.column(c).to_pylist() for c in ("word", "own", "sum"))):
            at = [k for k, w in enumerate(words) if w == word]
            assert n == own[at].sum() and np.allclose(np.frombuffer(vector, np.float32), sums[at].sum(axis=0))
        means = pa.Table.from_batches(skipgram._means(4)(got.to_batches()))
        assert np.allclose(means.column("vector")[0].as_py(), sums[[k for k, w in enumerate(words) if w == words[0]]].sum(axis=0) / got.column("own")[0].as_py())


def test_skipgram_against_plain_loops(monkeypatch):
    monkeypatch.setattr(skipgram, "WORDS_AT_ONCE", 64)
    rng = np.random.default_rng(3)
    ids, owner = rng.integers(0, 12, 333).astype(np.int32), np.sort(rng.integers(0, 9, 333)).astype(np.int32)
    counts, start = np.bincount(ids, minlength=12), skipgram.start_vectors(rng.integers(1, 2**62, 12), 8)
    got = skipgram.trained(ids, owner, counts, start.copy(), np.random.default_rng(1))

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    draws, vectors, out, seen = np.random.default_rng(1), start.copy(), np.zeros_like(start), np.zeros((2, 12))
    chances, reach = np.cumsum(counts**0.75), draws.integers(1, skipgram.WINDOW + 1, 333)
    for a in range(0, 333, 64):
        drawn = np.searchsorted(chances, draws.random(skipgram.DRAWN) * chances[-1], side="right")
        into, outof = np.zeros_like(start), np.zeros_like(start)
        for i in range(a, min(a + 64, 333)):
            near = [j for j in range(max(0, i - reach[i]), min(333, i + reach[i] + 1)) if j != i and owner[i] == owner[j]]
            for j in near:
                pull = sigmoid(-vectors[ids[i]] @ out[ids[j]])
                into[ids[i]] += pull * out[ids[j]]
                outof[ids[j]] += pull * vectors[ids[i]]
            for j in drawn:
                push = sigmoid(vectors[ids[i]] @ out[j]) * len(near) * skipgram.NEGATIVES / skipgram.DRAWN
                into[ids[i]] -= push * out[j]
                outof[j] -= push * vectors[ids[i]]
        for table, own, gradient in ((out, seen[1], outof), (vectors, seen[0], into)):
            own += (gradient**2).mean(axis=1)
            table += skipgram.RATE * gradient / np.sqrt(own + skipgram.EPSILON)[:, None]
    assert np.abs(got - vectors).max() < 1e-4
