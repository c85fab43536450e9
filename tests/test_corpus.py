"""Hashing, splits, prefix sums, tokens, vocabulary and packing."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnmill.functions import arrays
from tarnmill.markers import reserved_symbols
from tarnmill.operators import dedup, packing, prefix, repeats, skew, splits, subword, tokens, vocab
from tarnmill.operators.trie import Trie


def naive_simhash(text):
    kept = re.sub(r"\W", "", text.lower())
    grams = [kept[i : i + 4] for i in range(max(len(kept) - 3, 1))]
    hashes = [int(hashlib.md5(g.encode()).hexdigest(), 16) for g in grams]
    value = sum(1 << k for k in range(64) if sum(1 if h >> k & 1 else -1 for h in hashes) > 0)
    return value - (1 << 64) if value >> 63 else value


def test_simhash(spark):
    texts = ["", "ab", "abcd", "Hello, World!\n" * 40, "naïve café 数据 😀 𝒜𝒷𝒸𝒹", "x_y = 1\n", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r["i"]: r["h"] for r in df.select("i", dedup.simhash(F.col("text")).alias("h")).collect()}
    assert got == {i: naive_simhash(t) for i, t in enumerate(texts)}


def test_simhash_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefg \n😀") for _ in range(3000))
    for piece in (1, 7, 100, 2999):
        monkeypatch.setattr(dedup, "PIECE_CHARS", piece)
        assert dedup._vote(text, dedup._Digests()) == naive_simhash(text)


def test_digests_are_the_same_whatever_is_remembered(monkeypatch):
    rng = np.random.default_rng(4)
    letters = np.array([ord(c) for c in "abcdefghij"], np.uint64)
    batches = []
    for _ in range(30):
        four = rng.choice(letters, (50, 4))
        batches.append(np.unique(four[:, 0] << np.uint64(48) | four[:, 1] << np.uint64(32) | four[:, 2] << np.uint64(16) | four[:, 3]))
    want = [dedup._Digests().of(grams).tolist() for grams in batches]
    for new, most in ((1 << 13, 1 << 18), (60, 200), (0, 0)):
        monkeypatch.setattr(dedup, "NEW_GRAMS", new)
        monkeypatch.setattr(dedup, "MEMO_GRAMS", most)
        memo = dedup._Digests()
        assert [memo.of(grams).tolist() for grams in batches] == want


def test_lookup_by_join_with_a_hot_piece(spark, monkeypatch):
    rows = [(i, ["<EOL>"] * 18 + [f"p{i % 7}", "zzz"]) for i in range(200)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "file_id int, tokens array<string>")
    vocab_table = spark.createDataFrame([("<EOL>", 5), *[(f"p{k}", 10 + k) for k in range(7)]], "piece string, id int")
    sent = {r["file_id"]: r["ids"] for r in tokens.pieces_to_ids(df, vocab_table).collect() if r["ids"]}
    monkeypatch.setattr(tokens, "MAX_SENT_PIECES", 2)
    joined = {r["file_id"]: r["ids"] for r in tokens.pieces_to_ids(df, vocab_table).collect() if r["ids"]}
    assert joined == sent and len(joined) == 200


def test_unique_files_with_a_hot_group(spark):
    rows = [(f"f{i:04d}", "r", 7 if i % 3 == 0 else i) for i in range(900)]
    meta = spark.createDataFrame(rows, "file_id string, repo string, hash bigint")
    found = {r["hash"]: (r["file_id"], r["copies"]) for r in dedup.unique_files(meta).collect()}
    assert found[7] == ("f0000", 301) and len(found) == 600
    assert dedup.duplicate_count(dedup.unique_files(meta)).first()[0] == 300


def takes_its_share(rows, budget):
    """The lines of a split pass its budget with the last repository and not before."""
    lines = [n for _, n in rows]
    return not rows or sum(lines[:-1]) <= budget


@pytest.mark.parametrize("budgets", [(4, 4, 4), (5, 0, 0), (0, 0, 0), (17, 30, 200), (10**6, 1, 1)])
def test_assign_repos(spark, budgets):
    rng = random.Random(sum(budgets))
    repos = [(f"o/r{i}", 1, rng.choice([1, 5, 5, 20, 90]), 0) for i in range(40)]
    if budgets[0] < 6:
        repos = [(f"o/r{i}", 1, 5, 0) for i in range(4)]
    df = spark.createDataFrame(repos, "repo string, files bigint, num_lines bigint, num_comments bigint")
    limits = spark.createDataFrame([budgets], "exclude_lines bigint, test_lines bigint, train_lines bigint")
    order = sorted(((r[0], r[2]) for r in repos), key=lambda r: hashlib.md5((splits.SEED + r[0]).encode()).hexdigest())
    got = {r["repo"]: r["split"] for r in splits.assign_repos(df, limits).collect()}
    names = [got[repo] for repo, _ in order]
    # the splits follow each other in shuffled order
    assert names == sorted(names, key=[*splits.SPLITS, "validation"].index)
    for place, (name, budget) in enumerate(zip(splits.SPLITS, budgets)):
        own = [row for row in order if got[row[0]] == name]
        earlier = set([*splits.SPLITS][:place])
        left = [row for row in order if got[row[0]] not in earlier]
        assert takes_its_share(own, budget)
        # it goes on until the budget is passed or nothing is left; an empty one takes one
        assert sum(n for _, n in own) > budget or own == left
        assert own or not left


def test_split_statistics_have_all_rows(spark):
    assigned = spark.createDataFrame([("a", "test", 2, 10)], "repo string, split string, files bigint, num_lines bigint")
    dropped = spark.createDataFrame([(3,)], "duplicates bigint")
    rows = [tuple(r) for r in splits.split_statistics(assigned, dropped).collect()]
    assert rows == [("Excludes", 0, 0, None), ("Test", 2, 10, None), ("Train", 0, 0, None), ("Validation", 0, 0, None), ("Total", 2, 10, 3)]


def test_split_files_with_a_hot_repo(spark):
    files = spark.createDataFrame([("hot" if i % 3 else f"r{i % 90}", i) for i in range(900)], "repo string, file_id int")
    repos = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files")).withColumn("split", F.when(F.col("repo") == "hot", "train").otherwise("test"))
    assert skew.hot_keys(repos, "repo", "files") == ["hot"]
    got = splits.split_files(files, repos)
    assert got.count() == 900
    assert got.where("split = 'train'").count() == 600
    assert got.where("repo = 'hot' and split <> 'train'").count() == 0


@pytest.mark.parametrize("partitions", [1, 8, 1024])
def test_running_total(spark, partitions, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 9)}", i, rng.randint(0, 50)) for i in range(2000)]
    expected, total = {}, 0
    for k, i, n in sorted(rows):
        expected[k, i] = total
        total += n
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "k string, i int, n int")
        got = prefix.running_total(df, ["k", "i"], {"before": F.col("n")})
        assert {(r["k"], r["i"]): r["before"] for r in got.collect()} == expected
        assert got.columns == ["k", "i", "n", "before"]
        # one key column, as numbers and as strings, from a range and from a file
        numbers = spark.range(3000).withColumn("s", F.concat(F.lit("key "), F.lpad("id", 6, "0")))
        numbers.write.parquet(str(tmp_path / "n"))
        for source in (numbers, spark.read.parquet(str(tmp_path / "n"))):
            for key in ("id", "s"):
                placed = prefix.running_total(source, [key], {"place": F.lit(1), "sum": F.col("id")})
                assert placed.where("place <> id or sum <> id * (id - 1) / 2").isEmpty() and placed.count() == 3000
        assert prefix.running_total(numbers.limit(0), ["id"], {"place": F.lit(1)}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_take_fraction(spark):
    df = spark.range(10)
    assert [r["id"] for r in prefix.take_fraction(df, ["id"], 0.37).orderBy("id").collect()] == [0, 1, 2]
    assert prefix.take_fraction(df, ["id"], 1.0).count() == 10


def naive_blocks(files, size, fraction):
    flat = [x for _, ids in files for x in ids]
    flat = flat[: int(len(flat) * fraction)]
    return [flat[i : i + size] for i in range(0, len(flat) - size + 1, size)]


@pytest.mark.parametrize("fraction", [1.0, 0.5, 0.0])
@pytest.mark.parametrize("epoch", [0, 1])
def test_pack_blocks(spark, fraction, epoch):
    rng = random.Random(9)
    files = [(i, [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 3, 7, 40, 300]))]) for i in range(120)]
    df = spark.createDataFrame(files, "file_id int, ids array<int>").repartition(5)
    order = files
    if epoch:
        order = sorted(files, key=lambda f: hashlib.md5(f"{splits.SEED}:{epoch}:{f[0]}".encode()).hexdigest())
    got = packing.pack_blocks(df, 16, fraction, epoch).orderBy("block_id").collect()
    assert [r["input_ids"] for r in got] == naive_blocks(order, 16, fraction)
    assert [r["block_id"] for r in got] == list(range(len(got)))


def test_pack_small_case(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5]), (3, [6, 7, 8])], "file_id int, ids array<int>")
    assert [r[1] for r in packing.pack_blocks(df, 3).orderBy("block_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [r[1] for r in packing.pack_blocks(df, 3, 0.5).collect()] == [[1, 2, 3]]


def test_reserved_ids():
    symbols = reserved_symbols(2)
    assert symbols[0] == "<unk>" and symbols[3] == "<pad>" and symbols[4] == "<INDENT>" and symbols[9] == "<BOF>"
    assert symbols[-3:] == ["<RES0>", "<RES1>", "<EOL>"]


def test_ids_by_lookup_and_by_join(spark, monkeypatch):
    table = tokens.reserved_table(spark).unionByName(spark.createDataFrame([("a", 100), ("b", 101)], "piece string, id int"))
    df = spark.createDataFrame([(1, ["a", "b", "zz", "a"]), (2, []), (3, ["b"]), (4, None)], "file_id int, tokens array<string>")
    small = {r["file_id"]: r["ids"] for r in tokens.pieces_to_ids(df, table).collect()}
    assert small[1] == [100, 101, 0, 100] and small[2] == [] and small[3] == [101]
    monkeypatch.setattr(tokens, "MAX_SENT_PIECES", 3)
    joined = tokens.pieces_to_ids(df, table)
    large = {r["file_id"]: r["ids"] for r in joined.collect()}
    assert {k: large[k] for k in (1, 2, 3)} == {k: small[k] for k in (1, 2, 3)}
    back = tokens.ids_to_pieces(joined.select("file_id", "ids"), table)
    assert {r["file_id"]: r["tokens"] for r in back.collect()}[1] == ["a", "b", "<unk>", "a"]


def test_only_rare_pieces_are_joined(spark, monkeypatch):
    """Of a large vocabulary the low ids are sent; other elements alone meet the rest of it."""
    rows = [(k, ["p0", f"p{k % 40}", "none", "p1", f"p{k}", None]) for k in range(300)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "file_id int, tokens array<string>")
    table = spark.createDataFrame([(f"p{k}", k) for k in range(200)], "piece string, id int")
    small = {r["file_id"]: r["ids"] for r in tokens.pieces_to_ids(df, table).collect()}
    want = {k: [0, k % 40, 0, 1, k if k < 200 else 0, 0] for k in range(300)} | {900: [], 901: []}
    assert small == want
    monkeypatch.setattr(tokens, "MAX_SENT_PIECES", 50)
    joined_rows = []
    join = tokens.join_on_skewed_key

    def counted(big, *others):
        joined_rows.append(big.count())
        return join(big, *others)

    monkeypatch.setattr(tokens, "join_on_skewed_key", counted)
    found = tokens.pieces_to_ids(df, table, drop=["tokens"])
    assert found.columns == ["file_id", "ids"] and {r["file_id"]: r["ids"] for r in found.collect()} == want
    # unknown ones, and those from id 50 on
    assert joined_rows == [300 + 300 + 250]
    back = tokens.ids_to_pieces(found, table, "ids", "pieces", ["ids"])
    pieces = {r["file_id"]: r["pieces"] for r in back.collect()}
    assert pieces == {k: [f"p{i}" for i in ids] for k, ids in want.items()}


def test_framing_skips_empty_files(spark):
    df = spark.createDataFrame([(1, [["a"], []]), (2, [])], "file_id int, lines array<array<string>>")
    rows = tokens.frame_files(df).collect()
    assert [(r["file_id"], r["tokens"]) for r in rows] == [(1, ["<BOF>", "a", "<EOL>", "<EOL>", "<EOF>"])]


def test_line_helpers(spark):
    df = spark.createDataFrame([([["a", "b"], ["<COMMENT>", "c"], []],)], "lines array<array<string>>")
    row = df.select(arrays.join_lines(F.col("lines")), arrays.lines_containing(F.col("lines"), "<COMMENT>")).first()
    assert row[0] == "a b\n<COMMENT> c\n" and row[1] == [1]


def all_segmentations(word, scores):
    if not word:
        yield (), 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in scores:
            for rest, score in all_segmentations(word[k:], scores):
                yield (word[:k], *rest), scores[word[:k]] + score


def plain_path(word, scores, unknown):
    """The best way to cut a word; of equal ones that with the longest last piece, and so on."""
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            score = scores.get(piece, unknown if len(piece) == 1 else None)
            if score is not None and (end not in best or best[start][0] + score > best[end][0]):
                best[end] = (best[start][0] + score, best[start][1] + [piece])
    return best[len(word)][1]


def test_expected_counts_and_best_paths():
    scores = {p: math.log(w) for p, w in {"a": 0.3, "b": 0.2, "ab": 0.25, "ba": 0.1, "aba": 0.15}.items()}
    segmenter = subword.Segmenter(scores)
    for word in ["a", "ab", "abab", "ababa"]:
        ways = list(all_segmentations(word, scores))
        total = sum(math.exp(s) for _, s in ways)
        expected = {}
        for pieces, s in ways:
            for p in pieces:
                expected[p] = expected.get(p, 0) + math.exp(s) / total
        counts = dict(zip(segmenter.pieces, segmenter.expected(pa.array([word]), np.array([1]))))
        assert {p: round(c, 9) for p, c in counts.items() if c} == {p: round(c, 9) for p, c in expected.items()}
        best = max(ways, key=lambda w: w[1])
        assert math.isclose(segmenter.best(pa.array([word]))[1][-1], best[1])
    long = dict(zip(segmenter.pieces, segmenter.expected(pa.array(["ab" * 3000]), np.array([1]))))
    assert abs(sum(len(p) * c for p, c in long.items()) - 6000) < 1


def test_cut_words_equal_plain_paths_ties_too():
    rng = random.Random(4)
    letters = "abé▁🙂"
    pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)} - {"🙂"}
    # few different scores make many ties
    scores = {p: -float(rng.randint(1, 3)) * len(p) for p in sorted(pieces)}
    words = ["".join(rng.choice(letters + "x") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = subword.Segmenter(scores).cut(pa.array(words, pa.string())).to_pylist()
    assert got == [plain_path(w, scores, min(scores.values()) - subword.UNKNOWN_PENALTY) if w else [] for w in words]


def test_pieces_cost_what_others_add():
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "aba": -9.0, "c": -1.0, "cc": -1.5}
    segmenter = subword.Segmenter(scores)
    assert dict(zip(segmenter.pieces, segmenter.loss().tolist())) == {"a": 0.0, "b": 0.0, "ab": 0.5, "aba": -5.5, "c": 0.0, "cc": 0.5}
    used = segmenter.used(pa.array(["abcc", "aba", "x"]), np.array([2, 3, 7]))
    assert dict(zip(segmenter.pieces, used.tolist())) == {"a": 3.0, "b": 0.0, "ab": 5.0, "aba": 0.0, "c": 0.0, "cc": 2.0}


def test_fit_encode_and_decode(spark):
    lines = ["def read_file ( path ) :", "<INDENT> return open ( path ) . read ( )", "def read_files ( paths ) :", "ﬁle ½"]
    files = spark.createDataFrame([(i, lines) for i in range(5)], "file_id int, lines array<string>")
    counts = vocab.word_counts(files)
    found = {r["word"]: r["n"] for r in counts.collect()}
    assert found["▁read"] == 5 and found["▁file"] == 5 and "▁<INDENT>" not in found and found["▁1⁄2"] == 5
    table = vocab.fit_vocabulary(counts, 70)
    rows = table.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows))) and len(rows) <= 70
    assert [r["piece"] for r in rows][: len(reserved_symbols())] == reserved_symbols()
    scores = vocab.piece_scores(table)
    encoded = files.withColumn("pieces", subword.encode_lines(F.col("lines"), scores))
    first = encoded.first()["pieces"]
    assert first[1][0] == "<INDENT>"
    assert all(p in scores or p in reserved_symbols() for line in first for p in line)
    decoded = encoded.select(F.transform("pieces", tokens.decode_pieces)).first()[0]
    assert decoded[0] == lines[0] and decoded[3] == "file 1⁄2"


def brute_repeats(words):
    counts = {}
    for word, n in words:
        for i in range(len(word)):
            for k in range(i + 1, len(word) + 1):
                counts[word[i:k]] = counts.get(word[i:k], 0) + n
    letters = {c for w, _ in words for c in w}

    def grows(p, n):
        return any(counts.get(p + c) == n or counts.get(c + p) == n for c in letters)

    return {p: n for p, n in counts.items() if len(p) > 1 and n > 1 and not grows(p, n)}


@pytest.mark.parametrize("key,slice_size,parts", [(32, 4096, 1), (4, 3, 7), (2, 1, 3)])
def test_maximal_repeats_equal_brute_force(spark, monkeypatch, key, slice_size, parts):
    monkeypatch.setattr(repeats, "FIRST_KEY", key)
    monkeypatch.setattr(repeats, "SUFFIXES_PER_ROW", slice_size)
    rng = random.Random(11)
    words = [("▁" + "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 9))), rng.randint(1, 3)) for _ in range(60)]
    words += [("▁" + "abcdefghij" * 5, 3), ("▁" + "abcdefghij" * 4 + "x", 1), ("▁aaaaaaaaaaaa", 1)]
    words = sorted(dict(words).items())
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(words, "word string, n bigint")
        got = {r["piece"]: r["n"] for r in repeats.maximal_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_repeats(words)
    assert repeats.maximal_repeats(df.limit(0)).count() == 0


def test_seed_limit_keeps_the_best(spark):
    words = spark.createDataFrame([(f"▁w{i % 7}x{i}", i + 1) for i in range(60)], "word string, n bigint")
    everything = vocab.seed_pieces(words, 10**6).where(F.length("piece") > 1)
    best = everything.orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(20)
    limited = vocab.seed_pieces(words, 20).where(F.length("piece") > 1)
    assert {r["piece"] for r in limited.collect()} == {r["piece"] for r in best.collect()}


@pytest.mark.parametrize("times", [151, 1000])
def test_expected_counts_of_long_words(times):
    scores = {"a": -12.0, "b": -12.0, "abb": -13.0, "bab": -20.0}
    word = "bbabb" * times
    n = len(word)

    def add(values):
        top = max(values, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))

    until, after = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(1, n + 1):
        until[i] = add([until[i - len(p)] + s for p, s in scores.items() if word[:i].endswith(p, max(0, i - 3))])
    for i in range(n - 1, -1, -1):
        after[i] = add([after[i + len(p)] + s for p, s in scores.items() if word.startswith(p, i)])
    want = {p: sum(math.exp(until[i] + s + after[i + len(p)] - until[n]) for i in range(n) if word.startswith(p, i)) for p, s in scores.items()}
    segmenter = subword.Segmenter(scores)
    got = dict(zip(segmenter.pieces, segmenter.expected(pa.array([word]), np.array([1])).tolist()))
    assert {p: pytest.approx(c, rel=1e-6, abs=1e-9) for p, c in want.items()} == {p: got.get(p, 0.0) for p in scores}


def test_words_that_cannot_be_spelled_count_nothing():
    segmenter = subword.Segmenter({"a": -1.0, "b": -1.0})
    assert segmenter.expected(pa.array(["axb", "", "ab"]), np.array([5, 1, 2])).tolist() == [2.0, 2.0]


def test_character_coverage(spark):
    words = spark.createDataFrame([("▁aaab", 1000), ("▁a]é", 1)], "word string, n bigint")
    pieces = {r["piece"] for r in vocab.fit_vocabulary(words, 60, character_coverage=0.999).collect()}
    assert {"▁", "a", "b"} <= pieces and not any(c in p for p in pieces - set(reserved_symbols()) for c in "é]")
    assert "é" in {r["piece"] for r in vocab.fit_vocabulary(words, 60).collect()}


def test_encoding_takes_the_longest_piece(spark):
    piece = "▁" + "long" * 10
    df = spark.createDataFrame([([piece[1:]],)], "lines array<string>")
    assert df.select(subword.encode_lines(F.col("lines"), {piece: -1.0, "l": -2.0})).first()[0] == [[piece]]
    reserved = spark.createDataFrame([(["<RES0> <RES3>"],)], "lines array<string>")
    got = reserved.select(subword.encode_lines(F.col("lines"), {"<": -1.0, "▁": -1.0}, 3)).first()[0][0]
    assert got[0] == "<RES0>" and "<RES3>" not in got


def test_words_seen_before_are_not_cut_again(monkeypatch):
    cut = []
    own = subword.Segmenter.cut

    def counted(self, words):
        cut.extend(words.to_pylist())
        return own(self, words)

    monkeypatch.setattr(subword.Segmenter, "cut", counted)
    segmenter = subword.Segmenter({"▁": -1.0, "a": -2.0, "b": -2.0, "▁ab": -2.5})
    encoder = subword.Encoder(segmenter, ["<EOL>"])
    first = encoder.lines(pa.array(["ab ba <EOL>", None, "ab"]))
    assert first.to_pylist() == [["▁ab", "▁", "b", "a", "<EOL>"], [], ["▁ab"]]
    assert encoder.lines(pa.array(["ba x ab", "<EOL> ba", ""])).to_pylist() == [["▁", "b", "a", "▁", "x", "▁ab"], ["<EOL>", "▁", "b", "a"], []]
    assert sorted(w for w in cut if w != "▁") == ["▁ab", "▁ba", "▁x"]
    # what is remembered is bounded, and changes no result
    monkeypatch.setattr(subword, "REMEMBERED", 2)
    lines = [f"ab w{i % 5} ba <EOL>" for i in range(20)]
    want = subword.Encoder(segmenter, ["<EOL>"]).lines(pa.array(lines)).to_pylist()
    few = subword.Encoder(segmenter, ["<EOL>"])
    assert [few.lines(pa.array([line])).to_pylist()[0] for line in lines] == want
    assert len(few.known) <= 4


def test_trie_finds_all_pieces():
    rng = random.Random(9)
    pieces = sorted({"".join(rng.choice("abcé🙂\x00") for _ in range(rng.randint(1, 5))).encode() for _ in range(400)} | {b"abc" * 40})
    rng.shuffle(pieces)
    text = "".join(rng.choice("abcdé🙂\x00") for _ in range(500)).encode() + b"abc" * 41
    starts, stops, values = Trie.of(pieces).matches(np.frombuffer(text, np.uint8), np.full(len(text), len(text)))
    want = {(at, at + len(p), k) for k, p in enumerate(pieces) for at in range(len(text)) if text.startswith(p, at)}
    assert set(zip(starts.tolist(), stops.tolist(), values.tolist())) == want and len(starts) == len(want)
    assert len(Trie.of([]).matches(np.frombuffer(text, np.uint8), np.full(len(text), len(text)))[0]) == 0


def test_words_are_counted_where_they_lie(spark):
    lines = ["a  b\ta", "", None, "\u00a0x", "ﬁ ﬁ <EOL>", "c\u2003d a"]
    files = spark.createDataFrame([(lines,), (None,), (lines[:1],)], "lines array<string>").coalesce(1)
    counted = vocab.word_counts(files)
    assert {r["word"]: r["n"] for r in counted.collect()} == {"▁a": 5, "▁b": 2, "▁x": 1, "▁fi": 2, "▁c": 1, "▁d": 1}
    # no row for every occurrence of a word goes to the aggregation
    assert "explode" not in counted._jdf.queryExecution().executedPlan().toString()


def test_suffix_tree_nodes_of_a_stretch():
    # sorted distinct suffix keys: (text, count, whole suffix)
    rows = [("a", 2, True), ("ab", 1, True), ("abc", 4, True), ("abd", 1, True), ("b", 3, True), ("bcd", 1, False), ("c", 1, True)]
    keys, counts, whole = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    at, depth, count, edge = repeats.nodes(keys, counts, whole)
    assert all(isinstance(column, np.ndarray) for column in (at, depth, count, edge))
    found = sorted((keys[k][:d], n, e) for k, d, n, e in zip(at.tolist(), depth.tolist(), count.tolist(), edge.tolist()))
    assert found == [("a", 8, True), ("ab", 6, False), ("abc", 4, False), ("abd", 1, False), ("b", 4, False), ("c", 1, True)]
