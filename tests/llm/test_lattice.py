import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from support import empty, prose, table, texts

from tarnmill.llm import lattice
from tarnmill.operators.trie import Trie


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def remainder(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def paths(word, logs):
    """The probability of a word by trying every way to cut it."""
    if not word:
        return 1.0
    return sum(logs[word[:k]] * paths(word[k:], logs) for k in range(1, len(word) + 1) if word[:k] in logs)


def test_forward_sums_every_path_and_expected_counts_add_up():
    pieces = [bytes([b]) for b in range(256)] + ["▁".encode(), "▁a".encode(), b"ab", b"aba", b"ba", "▁abab".encode()]
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces) + 1)))
    model = lattice.Model(Trie.of(pieces), logs)
    words = ["a", "abab", "bababa", "aé", "", "abababababa"]
    chances = {p: math.exp(v) for p, v in zip(pieces, logs)}
    got = model.words(pa.array(words))
    want = [math.log(paths(("▁" + w).encode(), chances)) for w in words]
    assert got == pytest.approx(want, rel=1e-9)
    # the pieces of a word's paths spell its bytes
    counts = np.array([3, 1, 4, 1, 5, 9])
    expected = model.expected(pa.array(words), counts)
    spelt = sum(len(p) * n for p, n in zip(pieces, expected))
    assert spelt == pytest.approx(sum(c * len(("▁" + w).encode()) for w, c in zip(words, counts)))
    # one round of expectation and maximisation raises the likelihood
    better = lattice.Model(model.trie, np.log(expected + 1e-9) - math.log(expected.sum() + 1e-9 * len(expected)))
    assert (better.words(pa.array(words)) * counts).sum() > (got * counts).sum()


def plain(rows):
    train = [i is not None and remainder(i) != 1 for i, _ in rows]
    counts = collections.Counter(w for (_, t), use in zip(rows, train) if use for w in tokens(t))
    n_texts = sum(train)
    total, distinct = sum(counts.values()) + n_texts, len(counts) + 1
    out = []
    for i, t in rows:
        own = [counts[w] for w in tokens(t)] + [n_texts]
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in own)
        out.append((i, remainder(i) == 1, len(own), sum(c > 0 for c in own), total, round(base, 6)))
    return sorted(out, key=repr)


def more():
    return texts() + [(100 + k, prose(k % 7, 50 + k)) for k in range(40)] + [(300, "z" * 30000 + " " + "é" * 500)]


@pytest.fixture(scope="module")
def scores(spark):
    return lattice.scored(table(spark, more()).repartition(3), rounds=3).collect()


def test_counts_and_base_equal_a_plain_model(scores):
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scores]
    assert sorted(got, key=repr) == plain(more())


def test_scores_equal_one_plain_fit(spark, scores):
    """The same rounds without Spark, words taken one by one."""
    pieces, logs = lattice.vocabulary(lattice.vocabulary_path())
    logs = np.append(logs, logs.max())
    logs -= np.logaddexp.reduce(logs)
    train = [(i, t) for i, t in more() if i is not None and remainder(i) != 1]
    counts = collections.Counter(w for _, t in train for w in tokens(t))
    model = lattice.Model(Trie.of(pieces), logs)
    for _ in range(3):
        sums = np.full(len(model.logs), lattice.SMOOTHING)
        for word, c in counts.items():
            sums += model.expected(pa.array([word]), np.array([c])) if len(word) < 1000 else 0
        long = [w for w in counts if len(w) >= 1000]
        for word in long:
            sums += model.expected(pa.array([word]), np.array([counts[word]]))
        sums[-1] += len(train)
        model = lattice.Model(model.trie, np.log(sums / sums.sum()))
    for r in scores[:: max(1, len(scores) // 12)]:
        text = dict(((i, t) for i, t in more())).get(r["doc_id"])
        if r["doc_id"] in (4, None):
            continue
        own = sum(float(model.words(pa.array([w]))[0]) for w in tokens(text)) + model.logs[-1]
        assert r["score"] == pytest.approx(own / math.log(10), rel=1e-6)


def test_no_training_rows_empty_tables_and_null_texts(spark):
    assert lattice.scored(empty(spark)).count() == 0
    held = next(i for i in range(1, 100) if remainder(i) == 1)
    (row,) = lattice.scored(table(spark, [(held, "the end")])).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 3, 0, 0, None)
    assert row["score"] < 0


def test_texts_of_the_kind_learned_from_score_higher(spark):
    rows = [(k, "the cat sat on the mat " * 5) for k in range(50)]
    held = [i for i in range(1000, 1100) if remainder(i) == 1][:2]
    rows += [(held[0], "the mat sat on the cat"), (held[1], "zq xv qqj wvk zz qxj")]
    got = {r["doc_id"]: r["score"] for r in lattice.scored(table(spark, rows)).collect()}
    assert got[held[0]] > got[held[1]] / 2
