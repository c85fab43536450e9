import collections
import math
import re

import numpy as np
from support import empty, prose, table, texts

from tarnmill.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    bags = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for b in bags for t in b)
    out = []
    for item_id, text in set(items):
        scored = []
        for (doc_id, _), bag, size in zip(docs, bags, sizes):
            score = 0
            for t in set(terms(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + (50 * size * n_docs) // total
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "The changed LINE of w1 w2 w3"), (2, prose(1, 60)), (3, None), (4, "?!"), (5, "nowhere"), (6, "é🙂 b a"), (7, prose(3, 40)), (7, "one two"), (7, "one two"), (8, "a " * 5000 + "one")]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score long")


def many():
    return texts() + [(1000 + k, prose(k, 30 + k)) for k in range(150)] + [(2000 + k, "one two") for k in range(60)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ranks_equal_brute_force(spark):
    docs = table(spark, many()).repartition(5)
    for k in (50, 3):
        assert rows(search.ranked(docs, benchmark(spark), k)) == brute(many(), ITEMS, k)


def test_small_segments_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(search, "BLOCK_BYTES", 600)
    monkeypatch.setattr(search, "chunks", lambda batches: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    docs = table(spark, many()[:60]).repartition(2)
    assert rows(search.ranked(docs, benchmark(spark), 4)) == brute(many()[:60], ITEMS, 4)


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    whole = search.span_hashes
    monkeypatch.setattr(search, "span_hashes", lambda *args: whole(*args) >> np.uint64(62))
    lexicon = search.Lexicon(["ab", "cd", "abc", "é", "x1", "ef", "gh"])
    assert lexicon.most > 1
    data = np.frombuffer("gh ab xy é cd abc".encode(), np.uint8)
    starts, stops, _ = search.word_bounds(data, np.array([0, len(data)]), search.ALNUM)
    assert lexicon.find(data, starts, stops).tolist() == [6, 0, -1, 3, 1, 2]


def test_accumulators_stop_and_scores_stay_exact():
    rng = np.random.default_rng(5)
    n, k = 4000, 10
    lists = []
    for weight, share in ((9000, 0.01), (5000, 0.05), (900, 0.4), (200, 0.6), (30, 0.9)):
        docs = np.flatnonzero(rng.random(n) < share)
        values = rng.integers(1000, 100000, len(docs))
        lists.append((weight, docs, values, int(values.max())))
    full = np.zeros(n, np.int64)
    for weight, docs, values, _ in lists:
        full[docs] += weight * values
    scores, made = search.accumulate(lists, n, k, 0)
    best = np.sort(full)[-k:]
    assert (np.sort(scores)[-k:] == best).all()
    assert (scores[scores > 0] == full[scores > 0]).all()
    assert made < (full > 0).sum() / 2


def test_empty_tables(spark):
    assert search.ranked(empty(spark), benchmark(spark)).count() == 0
    assert search.ranked(table(spark), benchmark(spark, [])).count() == 0
    assert search.ranked(table(spark, [(None, None), (1, "")]), benchmark(spark)).count() == 0
