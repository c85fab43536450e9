import os

import corpus_pipeline
import pyarrow.parquet as pq
from support import prose, table, texts
from test_near_dup import plain_classes
from test_quality_lines import plain_quality

from tarnmill.llm import lines, quality


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]




def test_stages_equal_plain_models(spark, tmp_path):
    item = prose(4242, 30)
    rows = [r for r in texts() if r != (4, prose(3, 200))] + [(4, prose(3, 200)), (60, prose(61, 50) + " " + item + " " + prose(62, 50))]
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    docs = table(spark, rows)
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, str(tmp_path / "sf"))
        assert after.columns == docs.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality_rules":
            rows = [r for r in rows if plain_quality(r[1])[-1]]
            assert sorted(got, key=repr) == sorted(rows, key=repr)
        elif name == "line_dedup":
            assert sorted(i or 0 for i, _ in got) == sorted(i or 0 for i, _ in rows)
            assert all(text.split("\n")[-2:][0] != "the same line of all" for _, text in got)
            rows = got
        elif name == "near_dedup":
            # one row of each class, under the smallest id of the class
            assert sorted((i for i, _ in got), key=repr) == sorted({c for _, c in plain_classes(rows)}, key=repr)
            rows = got
        else:
            assert sorted(i or 0 for i, _ in got) == sorted(i or 0 for i, _ in rows if i != 60)
    packed = stage("packed_sequences")(spark, docs, str(tmp_path / "sf"))
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in got}


def test_repeated_rows_and_missing_columns(spark):
    text = prose(5, 60)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1]
    assert corpus_pipeline.line_dedup(spark, docs, "").columns == ["doc_id", "text"]
    assert lines.MIN_DOCS == 10 and quality.MIN_WORDS == 20


def test_rows_without_ids_are_judged_too(spark, tmp_path):
    item, text = prose(4243, 30), prose(6, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dirty = f"{prose(7, 60)} {item} {prose(8, 60)}"
    docs = spark.createDataFrame([(None, text), (None, text), (None, text), (None, dirty), (3, prose(9, 60)), (3, prose(10, 60))], "doc_id long, text string")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert len(clean) == 5 and all(r["text"] != dirty for r in clean)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r["text"] for r in kept) == sorted([text, dirty, prose(9, 60), prose(10, 60)])


def test_run_over_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        return
    ids = set(pq.read_table(f"{sf}/documents.parquet")["doc_id"].to_pylist())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= ids
