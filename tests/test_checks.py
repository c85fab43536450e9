"""The check queries themselves, on the smallest given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from checks.run import compare

SMALLEST = "/root/testdata/sf0.001"
QUICK = ["unique_files", "split_statistics", "comment_texts", "comment_pairs", "packed_blocks", "roc_auc", "rouge_2", "merged_catalog"]

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="given tables are not here")


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 80


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALLEST}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@needs_tables
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, tables, name):
    good, note = compare(spark, tables, SMALLEST, name, entry_module.queries()[name], entry_module.oracle_sql()[name])
    assert good, note


@needs_tables
def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert [r["split"] for r in rows] == ["Excludes", "Test", "Train", "Validation", "Total"]


def test_headline_is_without_the_tokenizer_wrappers():
    import bench

    assert not {"code_token_lines", "restored_source"} & set(bench.HEADLINE)
    assert set(bench.HEADLINE) <= set(entry_module.queries())
