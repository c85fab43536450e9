"""Prediction metrics against naive computations."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import metrics
from tarnmill.operators.tokens import reserved_table
from tarnmill.plans import examples


def random_pairs(n=60):
    rng = random.Random(8)

    def text():
        return " ".join(rng.choice(["a", "b", "c", "d.", "e", "ff"]) for _ in range(rng.randint(1, 14)))

    return [(i, text(), text()) for i in range(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(random_pairs(), "k int, hypothesis string, reference string")


def sentence_words(text):
    return [" ".join(s.split()).split(" ") for s in text.split(".") if s]


def lcs_words(x, y):
    table = {(i, j): 0 for i in range(len(x) + 1) for j in range(len(y) + 1)}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            table[i, j] = table[i - 1, j - 1] + 1 if x[i - 1] == y[j - 1] else max(table[i - 1, j], table[i, j - 1])

    def walk(i, j):
        if not i or not j:
            return []
        if x[i - 1] == y[j - 1]:
            return [*walk(i - 1, j - 1), x[i - 1]]
        return walk(i - 1, j) if table[i - 1, j] > table[i, j - 1] else walk(i, j - 1)

    return walk(len(x), len(y))


def naive_rouge(h, r, n):
    hw, rw = ([w for s in sentence_words(t) for w in s] for t in (h, r))
    if n == "l":
        common = len({w for a in sentence_words(r) for b in sentence_words(h) for w in lcs_words(a, b)})
        hs, rs = set(hw), set(rw)
    else:
        hs, rs = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (hw, rw))
        common = len(hs & rs)
    p, q = (common / len(s) if s else 0.0 for s in (hs, rs))
    return p, q, 2 * p * q / (p + q + 1e-8)


def test_rouge(pairs):
    expected = {m: [sum(c) / 60 for c in zip(*[naive_rouge(h, r, n) for _, h, r in random_pairs()])] for m, n in (("rouge-1", 1), ("rouge-2", 2), ("rouge-l", "l"))}
    for row in metrics.rouge(pairs).collect():
        assert [row["p"], row["r"], row["f"]] == pytest.approx(expected[row["metric"]])


def test_corpus_bleu(pairs):
    matched, total = Counter(), Counter()
    h_len = r_len = 0
    for _, h, r in random_pairs():
        h, r = h.split(), r.split()
        h_len, r_len = h_len + len(h), r_len + len(r)
        for n in range(1, 5):
            hs, rs = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (h, r))
            matched[n] += sum((hs & rs).values())
            total[n] += max(1, sum(hs.values()))
    logs = math.log(matched[1] / total[1]) + sum(math.log((matched[n] + 1) / (total[n] + 1)) for n in (2, 3, 4))
    penalty = 1.0 if h_len > r_len else math.exp(1 - r_len / h_len)
    assert metrics.corpus_bleu(pairs).first()[0] == pytest.approx(penalty * math.exp(logs / 4))


def test_short_hypotheses_count_one_ngram(spark):
    df = spark.createDataFrame([("a", "a"), ("a b c d e", "a b c d e")], "hypothesis string, reference string")
    rows = {r["n"]: (r["matched"], r["total"]) for r in metrics.bleu_counts(df).collect()}
    assert rows == {1: (6, 6), 2: (4, 5), 3: (3, 4), 4: (2, 3)}


def test_character_bleu(spark, pairs):
    rows = random_pairs()
    shared = sum(len(set(h) & set(r)) for _, h, r in rows)
    totals = [sum(max(len(h) - k, 1 if k else 0) for _, h, _ in rows) for k in range(4)]
    expected = math.exp((math.log(shared / totals[0]) + sum(math.log(1 / (t + 1)) for t in totals[1:])) / 4)
    assert metrics.character_bleu(pairs).first()[0] == pytest.approx(expected)
    none = spark.createDataFrame([("ab", "xy")], "hypothesis string, reference string")
    assert metrics.character_bleu(none).first()[0] == 0.0


def test_edit_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), (" ", " ")], "hypothesis string, reference string")
    assert metrics.mean_edit_similarity(df).first()[0] == pytest.approx((2 / 3 + 1) / 2)


def test_normalise(spark):
    df = spark.createDataFrame([("",), ("Ab",)], "t string")
    assert [r[0] for r in df.select(metrics.normalise(F.col("t"))).collect()] == [" ", "ab"]
    assert df.select(metrics.normalise(F.col("t"), True)).collect()[1][0] == "Ab"


def test_unknown_metric_names_are_rejected(pairs):
    for names in (["xrougex"], [], ["bleu", "meteor"]):
        with pytest.raises(ValueError):
            metrics.evaluate(pairs, names)
    assert {r["metric"] for r in metrics.evaluate(pairs, ["levenshtein", "character_bleu"]).collect()} == {"levenshtein", "character_bleu"}


def test_generated_pieces_and_scores(spark):
    vocab = reserved_table(spark).unionByName(spark.createDataFrame([("▁x", 100), ("▁y", 101)], "piece string, id int"))
    generated = spark.createDataFrame([(1, ["▁x"], [100, 101, 0, 100])], "k int, prompt array<string>, ids array<int>")
    answer = examples.generated_pieces(generated, vocab, "k")
    assert answer.first()["pieces"] == ["▁y", "<EOL>", "▁x"]
    same = examples.score_predictions(answer, answer, "k", ["levenshtein", "bleu"])
    # two words have no trigram, but count as one that is missed
    assert {r["metric"]: round(r["value"], 6) for r in same.collect()} == {"levenshtein": 1.0, "bleu": round(0.25**0.25, 6)}
    source = examples.score_predictions(answer, answer, "k", ["levenshtein"], untokenise=True)
    assert source.first()["value"] == 1.0


def words_by_table(reference, hypothesis):
    """Walk back through the full table of lengths; an equal choice leaves the hypothesis's word."""
    lengths = {(i, j): 0 for i in range(len(reference) + 1) for j in range(len(hypothesis) + 1)}
    for i, word in enumerate(reference, 1):
        for j, other in enumerate(hypothesis, 1):
            lengths[i, j] = lengths[i - 1, j - 1] + 1 if word == other else max(lengths[i - 1, j], lengths[i, j - 1])
    i, j, taken = len(reference), len(hypothesis), []
    while i and j:
        if reference[i - 1] == hypothesis[j - 1]:
            taken.append(reference[i - 1])
            i, j = i - 1, j - 1
        elif lengths[i - 1, j] > lengths[i, j - 1]:
            i -= 1
        else:
            j -= 1
    assert len(taken) == lengths[len(reference), len(hypothesis)]
    return set(taken)


@pytest.mark.parametrize("most, kinds", [(6, 2), (12, 4), (30, 12), (200, 90)])
def test_bit_rows_equal_the_table(most, kinds):
    rng = random.Random(most)
    for _ in range(300 if most < 100 else 20):
        reference, hypothesis = ([f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, most))] for _ in range(2))
        bits = metrics._match_bits(hypothesis)
        assert metrics._common_words(reference, bits, len(hypothesis)) == words_by_table(reference, hypothesis)
    sides = [[[f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 8))] for _ in range(4)] for _ in range(2)]
    union = set().union(*(words_by_table(r, h) for r in sides[1] for h in sides[0]))
    assert metrics._union_size(*sides) == len(union)
