import collections
import datetime
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
from support import empty, prose, table, texts

from tarnmill.llm import decontaminate, toxicity

BAD = ["scum", "idiot", "moron"]


def labelled(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        words = prose(k + 1000, rng.randrange(20, 60)).split()
        toxic = int(k % 5 == 0)
        if toxic:
            for bad in rng.sample(BAD, 2):
                words[rng.randrange(len(words))] = bad
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    n, terms = 500, 40
    rows = np.repeat(np.arange(n), 5)
    places = np.concatenate([np.sort(rng.choice(terms, 5, replace=False)) for _ in range(n)])
    counts = rng.integers(1, 4, 5 * n)
    labels = rng.integers(0, 2, n)
    index = toxicity.Index(rng.random(terms) + 0.1, rows, places, counts, labels, list(range(n)))
    dense = np.zeros((n, terms))
    dense[rows, places] = np.log1p(counts) * index.idf[places]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for k in range(0, n, 7):
        found, cosines = index.nearest(places[5 * k : 5 * k + 5], counts[5 * k : 5 * k + 5], without=k)
        want = dense @ dense[k]
        want[k] = -1
        assert np.allclose(cosines, np.sort(want)[::-1][: toxicity.NEIGHBOURS])
        assert np.allclose(want[found], cosines)


def topical(rng, groups=32, size=80, terms=30):
    """Examples of clearly different topics, ``size`` each, that share a few common terms."""
    rows = np.repeat(np.arange(groups * size), 12)
    places = []
    for k in range(groups * size):
        topic = rng.choice(terms, 10, replace=False) + 5 + k % groups * terms
        places.append(np.sort(np.append(rng.choice(5, 2, replace=False), topic)))
    return rows, np.concatenate(places), rng.integers(1, 4, len(rows)), 5 + groups * terms


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(11)
    rows, places, counts, n_terms = topical(rng)
    n = rows[-1] + 1
    # every third example is a copy of its neighbour: ties across blocks
    for k in range(1, n, 3):
        places[12 * k : 12 * k + 12], counts[12 * k : 12 * k + 12] = places[12 * k - 12 : 12 * k], counts[12 * k - 12 : 12 * k]
    idf = np.append(np.full(5, 0.2), rng.random(n_terms - 5) + 2)
    index = toxicity.Index(idf, rows, places, counts, rng.integers(0, 2, n), list(range(n)))
    dense = np.zeros((n, n_terms))
    dense[rows, places] = np.log1p(counts) * idf[places]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    chosen = np.arange(0, n, 37)
    cuts = np.arange(len(chosen) + 1) * 12
    at = (chosen[:, None] * 12 + np.arange(12)).ravel()
    text, query = index.unit(cuts, places[at], counts[at])
    cosines, opened, _ = index.search(text, places[at], query, len(chosen))
    assert sorted(index.order) == list(range(n))
    assert opened.mean() < 0.3 and opened.any(axis=1).all()
    exact = dense[chosen] @ dense.T
    for k, (found, near, _) in enumerate(index.nearest_of(cuts, places[at], counts[at])):
        rounded = np.round(exact[k], 9)
        want = np.lexsort((np.arange(n), -rounded))[: toxicity.NEIGHBOURS]
        assert found.tolist() == want[rounded[want] > 0].tolist() and np.allclose(near, exact[k][found])
        spots = np.repeat(opened[k], toxicity.BLOCK)[:n]
        assert np.allclose(cosines[k][:n][spots], exact[k][index.order][spots])


def test_postings_are_added_once_for_all_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(12)
    rows, places, counts, n_terms = topical(rng)
    n = rows[-1] + 1
    index = toxicity.Index(np.append(np.full(5, 0.2), rng.random(n_terms - 5) + 2), rows, places, counts, rng.integers(0, 2, n), list(range(n)))
    vectors = np.zeros((n, n_terms))
    vectors[rows, places] = np.log1p(counts) * index.idf[places]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rare = np.bincount(places, minlength=n_terms) * toxicity.DENSE < n
    assert rare.any() and not rare.all()
    text, query = index.unit(np.arange(41) * 12, places[:480], counts[:480])
    cosines, opened, least = index.search(text, places[:480], query, 40)
    part, whole = (vectors[:40] * rare) @ vectors.T, vectors[:40] @ vectors.T
    spots = np.repeat(opened, toxicity.BLOCK, axis=1)[:, :n]
    assert not spots.all()
    assert np.allclose(cosines[:, :n], np.where(spots, whole[:, index.order], part[:, index.order]))
    assert (np.where(spots, 0, whole[:, index.order]).max(axis=1) < least).all()


def test_a_text_looks_up_all_its_neighbours_at_once():
    rows, places, counts = np.repeat(np.arange(40), 3), np.tile(np.arange(3), 40), np.ones(120, int)
    index = toxicity.Index(np.ones(3), rows, places, counts, np.arange(40) % 2, list(range(40)))

    class Weights(np.ndarray):
        lookups = 0

        def take(self, *args, **more):
            Weights.lookups += 1
            return np.asarray(self).take(*args, **more)

        def __getitem__(self, key):
            Weights.lookups += 1
            return np.asarray(self)[key]

    assert np.isclose(index.share(np.arange(40), np.ones(40), np.ones(3, np.float32).view(Weights)), 0.5)
    assert Weights.lookups == 1


def test_votes_are_weighed_by_evidence():
    # both neighbours are as near; only the term in common with the first depends on the label
    rows, places, counts = np.array([0, 0, 1, 1]), np.array([0, 2, 1, 3]), np.ones(4, int)
    even = toxicity.Index(np.ones(4), rows, places, counts, np.array([1, 0]), [7, 8])
    led = toxicity.Index(np.ones(4), rows, places, counts, np.array([1, 0]), [7, 8], np.array([3.0, 1, 1, 1]))
    shares = [next(i.nearest_of(np.array([0, 2]), np.array([0, 1]), np.ones(2, int)))[2] for i in (even, led)]
    assert np.allclose(shares, [0.5, 0.75])
    # an index travels as what it was made from
    sent = pickle.loads(pickle.dumps(led))
    assert np.allclose(next(sent.nearest_of(np.array([0, 2]), np.array([0, 1]), np.ones(2, int)))[2], 0.75)


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = labelled()
    label_table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, rows + [(i and i + 5000, t) for i, t in texts()]), label_table).collect()
    assert len(got) == len(rows) + len(texts())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    # labels of held-out rows are never learned from
    learned = {int(e.split(":")[0]) for r in got for e in r["evidence"].split(",") if e}
    assert learned and not learned & {r["doc_id"] for r in held}


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(table(spark), none).collect()} == {0.5}
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_every_term_of_the_examples_counts(spark):
    # no word depends on the label enough to be chosen, yet each text has a nearest example
    rows = [(k, prose(3000 + k, 30)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    learned = [k for k in range(60) if zlib.crc32(str(k).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    copies = [(1000 + k, rows[k][1]) for k in learned]
    got = {r["doc_id"]: r["evidence"] for r in toxicity.toxicity(table(spark, rows + copies), labels).collect()}
    assert [got[1000 + k].split(",")[0] for k in learned] == [f"{k}:{k % 2}:1.0000" for k in learned]


def test_calibration_is_monotone():
    froms, values = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.5, 0.9, 0.9]), np.array([0, 1, 0, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(froms) > 0).all()


def test_planted_items_are_found_and_clean_documents_are_not(spark):
    items = [(k, prose(9000 + k, 15 + k)) for k in range(30)]
    rows, want = [(i and i + 5000, t) for i, t in texts()], set()
    for k, (item, text) in enumerate(items):
        words = text.upper().split()
        if k % 3 == 1:
            del words[7]
        if k % 3 == 2:
            words[5:5] = ["well,", "then"]
        around = prose(9500 + k, 150).split()
        rows.append((100 + k, " ".join(around[:70] + words + around[70:])))
        rows.append((200 + k, prose(9700 + k, 200)))
        want.add((100 + k, item))
    rows.append((300, items[3][1]))
    benchmark = spark.createDataFrame([*items, (70, None), (71, ""), (73, items[3][1])], "item_id long, text string")
    got = decontaminate.contaminated(table(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(300, 3), (300, 73), (103, 73)}
    assert decontaminate.contaminated(empty(spark), benchmark).count() == 0
    assert decontaminate.contaminated(table(spark, rows), benchmark.limit(0)).count() == 0


def test_repeated_items_are_found_under_every_id(spark):
    rows = [(k, f"{prose(8000 + k, 60)} {prose(7000, 30)} {prose(8100 + k, 60)}") for k in range(3)]
    benchmark = spark.createDataFrame([(k, prose(7000, 30)) for k in range(12)], "item_id long, text string")
    got = decontaminate.contaminated(table(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, k) for d in range(3) for k in range(12)} and len(got) == 36


def test_short_and_edited_items_among_thousands_are_found(spark):
    rng = random.Random(11)
    places = [int(6000 ** rng.random() * 3) for _ in range(100_000)]
    words = iter(f"v{k}" for k in places)

    def some(n):
        return [next(words) for _ in range(n)]

    items = [some((3, 5, 8, 10, 15, 30, 60, 100)[k % 8]) for k in range(2400)]
    rows, want = [], set()
    for k in range(0, 2400, 41):
        copy = list(items[k])
        if len(copy) >= 8 and k % 2:
            for at in rng.sample(range(len(copy)), len(copy) * 3 // 10):
                copy[at] = "other"
        rows.append((k, " ".join(some(60) + copy + some(60))))
        want.add((k, k))
    benchmark = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["lcs_words"] for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()}
    assert want <= set(got)
    # some stretch of the text really covers what was found, and nothing that a stretch covers is missing
    code = {w: n for n, w in enumerate({w for i in items for w in i} | {w for _, t in rows for w in t.split()})}
    for k, text in rng.sample(rows, 6):
        text = np.array([code[w] for w in text.split()], np.uint64)
        for number in rng.sample(range(2400), 60):
            item = np.array([code[w] for w in items[number]], np.uint64)
            size = 2 * len(item) + 24 if len(item) >= decontaminate.SHORT else len(item)
            best = max(decontaminate.common_subsequence(item, text[a : a + size]) for a in range(max(1, len(text) - size + 1)))
            assert ((k, number) in got) == (best >= (0.6 * len(item) if len(item) >= decontaminate.SHORT else len(item)))


def test_answers_decide(spark):
    text = prose(77, 40)
    words = text.split()
    benchmark = spark.createDataFrame([(1, text, " ".join(words[-6:]))], "item_id long, text string, answer string")
    rows = [(1, text), (2, " ".join(words[:-6]) + " " + prose(78, 30))]
    assert [r["doc_id"] for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()] == [1]


def test_items_without_an_answer_need_no_last_sentence(spark):
    words = prose(79, 40).split()
    benchmark = spark.createDataFrame([(1, " ".join(words[:34]) + ". " + " ".join(words[34:]))], "item_id long, text string")
    rows = [(1, f"{prose(81, 60)} {' '.join(words[:34])} {prose(82, 60)}")]
    assert [r["doc_id"] for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()] == [1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == rows[-1][-1]


def test_sketch_is_the_co_occurrence_times_the_test_matrix():
    rng = np.random.default_rng(1)
    terms, passages = rng.integers(0, 20, 300), np.sort(rng.integers(0, 40, 300))
    w = decontaminate.test_matrix(20, 6)
    counts = np.zeros((40, 20))
    np.add.at(counts, (passages, terms), 1)
    present, z, df, n = decontaminate.sketch_of(terms, passages, w)
    assert np.allclose(z, (counts.T @ (counts @ w))[present], atol=1e-3)
    assert (df == (counts > 0).sum(axis=0)[present]).all() and n == len(np.unique(passages))
    assert isinstance(pa.array([1]), pa.Array)


def test_long_texts_and_other_kinds_of_ids(spark):
    item = prose(83, 40)
    words = item.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 4)
    rows = [(1, f"{prose(84, 6000)} {edited} {prose(85, 3000)}"), (2, prose(86, 9000)), (3, edited)]
    benchmark = spark.createDataFrame([(datetime.date(2020, 1, 2), item)], "item_id date, text string")
    got = decontaminate.contaminated(table(spark, rows), benchmark).collect()
    assert [(r["doc_id"], r["item_id"]) for r in sorted(got)] == [(1, datetime.date(2020, 1, 2)), (3, datetime.date(2020, 1, 2))]


def test_words_in_common_bound_the_subsequence():
    rng = random.Random(3)
    items = [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (8, 12, 20)]
    text = [rng.randrange(40) for _ in range(200)]
    block = decontaminate.Block([[k] for k in range(3)], items, [None] * 3)
    exact = decontaminate.Exact(block, np.zeros(len(block.terms), np.int64))
    hashes = decontaminate.words_of(pa.array([" ".join(f"w{w}" for w in text)]))[0]
    pairs = [(k, a, rng.randrange(a, 201)) for k in range(3) for a in range(0, 200, 9)]
    found = exact.common(*(np.array(x) for x in zip(*pairs)), block.term_of(hashes))
    for (k, a, b), n in zip(pairs, found):
        own, there = collections.Counter(items[k].split()), collections.Counter(f"w{w}" for w in text[a:b])
        assert n == sum((own & there).values()) >= decontaminate.common_subsequence(block.words[k], hashes[a:b])
