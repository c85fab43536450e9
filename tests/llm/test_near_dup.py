import collections
import random
import re

import numpy as np
import pyarrow as pa
from support import empty, prose, table, texts

from tarnmill.llm import near_dup


def sets_of(rows):
    elements, bounds = near_dup.multisets(pa.array([t for _, t in rows], pa.string()))
    return [set(elements[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]


def shingles_of(text):
    """The multiset of five-word shingles, written without the module under test."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    width = min(5, len(words))
    return collections.Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else collections.Counter()


def plain_classes(rows):
    bags = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(bags):
        for j, b in enumerate(bags[:k]):
            if a and (a & b).total() * 5 >= 4 * (a | b).total():
                x, y = find(k), find(j)
                label[max(x, y)] = min(x, y)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return sorted(((i, names.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        words = [f"w{i}" for i in rng.integers(0, 60, 400)]
        other = list(words)
        for j in rng.integers(0, 400, rng.integers(1, 40)):
            other[j] = f"x{rng.integers(0, 1000)}"
        column = pa.array([" ".join(words * 2), " ".join(other + words[:200])])
        signature = near_dup.signatures(*near_dup.weighted(*near_dup.shingles(column)), 2)
        a, b = sets_of([(0, column[0].as_py()), (1, column[1].as_py())])
        errors.append((signature[0] == signature[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_multisets_count_copies():
    a, b = sets_of([(0, "a b c d e " * 3), (1, "a b c d e " * 2)])
    # shingles of a five-word cycle: 11 and 6, of which 6 are shared
    assert (len(a), len(b), len(a & b)) == (11, 6, 6)


def test_classes_equal_brute_force(spark):
    base = prose(7, 60)
    words = base.split()
    rows = texts() + [(100 + k, " ".join(words[:k] + [f"new{k}"] + words[k + 1 :])) for k in range(0, 40, 2)]
    got = near_dup.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == plain_classes(rows)
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_texts_under_one_id_and_without_an_id(spark):
    a, b, c = prose(21, 90), prose(22, 90), prose(23, 90)

    def near(text):
        return text.replace(text.split()[40], "changed", 1)

    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(c)), (None, c), (9, c), (None, None), (None, prose(24, 50))]
    got = near_dup.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == plain_classes(rows)
    assert sorted(r["class_id"] for r in got if r["doc_id"] in (2, 3)) == [1, 1]
    # the two classes that share the name 1 stay apart where rows are the names
    numbered = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    of = {r["doc_id"]: r["class_id"] for r in near_dup.classes_of_rows(numbered).collect()}
    assert of[0] == of[2] != of[1] == of[3] and of[4] == of[5] == of[6]


def test_recall_of_planted_pairs(spark):
    """Pairs of similarity 0.8 to 0.9 between many unrelated texts."""
    rng = random.Random(8)
    rows, pairs = [], 0
    for k in range(150):
        words = prose(1000 + k, 120).split()
        other = list(words)
        for at in rng.sample(range(5, 115, 10), rng.randint(1, 2)):
            other[at] = f"n{k}x{at}"
        x, y = shingles_of(" ".join(words)), shingles_of(" ".join(other))
        if 0.8 <= (x & y).total() / (x | y).total() <= 0.93:
            pairs += 1
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    of = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(table(spark, rows)).collect()}
    assert pairs > 100
    assert sum(of[i] == of[i + 1] for i in of if i % 2 == 0) / pairs > 0.98


def test_blocks_find_links_between_components():
    text = prose(9, 80)
    words = text.split()
    column = pa.array([text, " ".join(words[:-3] + ["x", "y", "z"]), prose(10, 80)])
    elements, bounds = near_dup.multisets(column)
    bands = near_dup.bands(near_dup.signatures(*near_dup.weighted(*near_dup.shingles(column)), 3)).astype(np.int64)
    t = pa.table(
        {
            "of": [1] * 3, "i": [0] * 3, "j": [0] * 3, "node": [5, 6, 7], "label": [5, 6, 7], "block": [0] * 3,
            "bands": bands.tolist(), "elements": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(elements.astype(np.int64))),
        }
    )
    assert near_dup.compare_blocks(t).to_pylist() == [{"a": 5, "b": 6}]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dup.components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}
