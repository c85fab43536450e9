import collections
import re

import pytest
from support import empty, prose, table, texts

from tarnmill.llm import phrases


def pieces_of(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, least, first):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            totals[lang] += len(words)
            for m in range(1, 6):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inside[lang, words[i : i + m]] = max(inside[lang, words[i : i + m]], a)
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if inside[lang, words] >= a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    return sorted((lang, rank, row[2].decode(), *row[3:]) for lang, found in out.items() for rank, row in enumerate(sorted(found)[:first], 1))


def rows():
    some = [t for _, t in texts()]
    hot = ["New  York\tCity is big; new york city IS big! é über é über\x0bNew York, new york", "a a a a a a a a\na a a"] * 6
    mixed = [("en", t) for t in some + hot] + [(None, t) for t in hot] + [("und", hot[0])] + [("fr", prose(9, 300)), ("fr", None), ("de", "")]
    return mixed


def docs(spark, data):
    return spark.createDataFrame([(k, lang, text, 1, "x", 5) for k, (lang, text) in enumerate(data)], "doc_id long, lang string, text string, n long, phrase string, row long").repartition(3)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


# 7 bits: nearly all fingerprints collide
@pytest.mark.parametrize("keep,least,first", [(64, 4, 2000), (7, 4, 2000), (64, 6, 5)])
def test_collocations_equal_brute_force(spark, keep, least, first):
    got = collected(phrases.collocations(docs(spark, rows()), least, first, keep))
    want = brute(rows(), least, first)
    assert len(want) > 5 and got == want


def test_counts_without_representatives_and_with_small_sums(spark, monkeypatch):
    # functions travel by value with their module's values
    monkeypatch.setattr(phrases, "REPRESENTATIVES", 0)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert collected(phrases.collocations(docs(spark, rows()), 4)) == brute(rows(), 4, 2000)


def test_empty_tables_and_clashing_columns(spark):
    assert phrases.collocations(empty(spark), 2).count() == 0
    assert phrases.collocations(table(spark, [(None, None), (1, " .,")]), 2).count() == 0
    assert collected(phrases.collocations(table(spark), 3)) == brute([(None, t) for _, t in texts()], 3, 2000)


def test_sums_leave_a_task_as_one_row_a_range():
    import numpy as np

    fp = np.sort(np.random.default_rng(4).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    sums = phrases.Sums()
    sums.add(fp, np.ones(5000, np.int64), np.arange(5000), np.arange(5000).astype(np.int32), np.full(5000, 2, np.int8))
    rows = [row for batch in sums.batches(16) for row in batch.to_pylist()]
    assert [row["segment"] for row in rows] == list(range(16))
    held = [phrases.of_planes(row["sums"], row["held"]) for row in rows]
    assert (np.concatenate([columns[0] for columns in held]) == fp).all()
    assert (np.concatenate([columns[2] for columns in held]) == np.arange(5000)).all()


def test_a_rare_phrase_costs_few_bytes_and_no_pointer():
    import numpy as np
    import pyarrow as pa

    fp = np.random.default_rng(6).integers(0, 1 << 63, 200_000).astype(np.uint64)
    sums = phrases.Buckets()
    sums.add(fp)
    sums.add(fp[:1000])
    rows = [row for batch in sums.batches(16) for row in batch.to_pylist()]
    assert [row["segment"] for row in rows] == list(range(16))
    held = [phrases.of_planes(row["sums"], row["held"], phrases._BUCKET_COLUMNS) for row in rows]
    buckets, n = np.unique(np.concatenate([fp, fp[:1000]]).astype(np.uint32), return_counts=True)
    assert (np.concatenate([np.cumsum(steps, dtype=np.uint32) for steps, _ in held]) == buckets).all()
    assert (np.concatenate([n for _, n in held]) == n).all()
    assert sum(len(pa.compress(row["sums"], "lz4", asbytes=True)) for row in rows) < 4 * len(fp)


def test_buckets_lose_nothing_when_sorted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    stored = docs(spark, rows()).selectExpr("doc_id as row", "coalesce(text, '') as text", "coalesce(lang, 'und') as lang")
    got = [r["fp"] for r in phrases.busy_buckets(stored, [1], 6, 64).collect()]
    want = collections.Counter((("und" if lang is None else lang), w) for lang, text in rows() for words in pieces_of(text) for w in words)
    assert len(got) == len(set(got)) == sum(n >= 6 for n in want.values()) > 20
