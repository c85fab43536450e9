"""Whole jobs on a small tree of Python files."""

import random

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import catalog, classify, sequences
from tarnmill.operators.packing import pack_blocks
from tarnmill.plans.corpus import CorpusBuild, build_corpus
from tarnmill.plans.examples import finetune_batches


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = []
    for repo in range(12):
        for i in range(6):
            body = "".join(f"    # set the value of field {rng.randint(0, 9)}\n    v{k} = {rng.randint(0, 99)}\n" for k in range(rng.randint(1, 8)))
            rows.append((f"o{repo}/r/f{i}.py", f"o{repo}/r", f"def run(a):\n{body}    return a\n\n\nrun(1)\n"))
    rows.append(("o1/r/copy.py", "o1/r", rows[0][2]))
    rows.append(("o1/r/broken.py", "o1/r", "x = (\n"))
    rows.append(("o1/r/plain.py", "o1/r", "x = 1\n"))
    files = spark.createDataFrame(rows, "file_id string, repo string, text string")
    labelled = spark.createDataFrame(
        [("positive", "set the value"), ("negative", "fixme hack")] * 10, "label string, text string"
    )
    model = classify.fit_classifier(labelled, {"num_features": 1 << 8, "max_iter": 10})
    folder = str(tmp_path_factory.mktemp("build"))
    blocks = build_corpus(files, folder, model, 0.5, vocab_size=120, block_size=32)
    return folder, blocks, model


def test_no_repo_is_in_two_splits(spark, built):
    splits = spark.read.parquet(built[0] + "/splits")
    assert splits.groupBy("repo").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert splits.select("file_id").distinct().count() == splits.count()


def test_tables_agree(spark, built):
    folder, blocks, _ = built
    tokenised = spark.read.parquet(folder + "/tokenised")
    assert tokenised.where("file_id like '%broken%' or file_id like '%plain%'").count() == 0
    unique = spark.read.parquet(folder + "/unique")
    assert unique.agg(F.sum("copies")).first()[0] == tokenised.count()
    statistics = spark.read.option("header", True).csv(folder + "/split_statistics")
    total = statistics.where("split = 'Total'").first()
    assert int(total["files"]) == unique.count()
    ids = spark.read.parquet(folder + "/ids_train")
    flat = [x for r in ids.orderBy("file_id").collect() for x in r["ids"]]
    packed = [x for r in blocks["train"].orderBy("block_id").collect() for x in r["input_ids"]]
    assert packed == flat[: len(flat) // 32 * 32] and len(packed) > 0
    assert 0 not in flat


def test_packing_does_not_depend_on_partitions(spark, built):
    ids = spark.read.parquet(built[0] + "/ids_train")
    results = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(pack_blocks(ids, 32, epoch=3).orderBy("block_id").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_finetune_batches(spark, built):
    folder, _, model = built
    tokens = spark.read.parquet(folder + "/tokens_train")
    vocabulary = spark.read.parquet(folder + "/vocabulary")
    batches = finetune_batches(tokens, vocabulary, 8, model, max_context_length=40, fold_functions=True).collect()
    assert batches
    for row in batches:
        pads = row["attention_mask"].count(0)
        assert len(row["input_ids"]) == len(row["labels"]) == len(row["attention_mask"])
        assert row["input_ids"][:pads] == [3] * pads and row["labels"][:pads] == [-100] * pads
    few = finetune_batches(tokens, vocabulary, 8, fraction=0.25).count()
    every = sequences.comment_pairs(tokens).count()
    assert few == every // 4


def test_stages_can_be_repeated(spark, built):
    build = CorpusBuild(built[0])
    tokenised = spark.read.parquet(built[0] + "/tokenised")
    before = {tuple(r) for r in spark.read.parquet(built[0] + "/splits").select("split", "file_id").collect()}
    again = {tuple(r) for r in build.split(tokenised).select("split", "file_id").collect()}
    assert before == again


@pytest.mark.parametrize("limit", [0, 3, 7, 50])
def test_first_rows_in_one_task_or_numbered(spark, monkeypatch, limit):
    monkeypatch.setattr(catalog, "TOP_ROWS", 5)
    df = spark.createDataFrame([(k * 7 % 30, f"v{k}") for k in range(30)], "id int, v string").repartition(4)
    got = sorted(r["id"] for r in catalog.first_rows(df, ["id"], limit).collect())
    assert got == list(range(min(limit or 30, 30)))
