import zlib

import numpy as np
import pyarrow as pa
import pytest
from support import empty, table, texts
from tokenizers import Tokenizer

from tarnmill.llm import packing, rans, token_files
from tarnmill.llm.tokens import Encoder, Fingerprints, tokenizer_path

ODD = ["a <|endoftext|> b", "x<|startoftext|>y", "é é ́x ΑΣ ΑΣ. İ don't 'S", None, "", " \n", "a\x1cb c", "ﬁ １２３ 12345 ½", "a b c　d​e\x85g", "hi 🙂👍🏽 中文 x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def plain_ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_cached_encoding_is_the_tokenizers(tokenizer, monkeypatch):
    rows = ODD + [t for _, t in texts() if t is None or len(t) < 5000]
    for memory in (400_000, 10):
        monkeypatch.setattr("tarnmill.llm.tokens.MEMORY", memory)
        encoder = Encoder(tokenizer_path())
        for _ in range(2):
            ids, bounds = encoder.encode(pa.array(rows, pa.string()))
            for k, text in enumerate(rows):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_random_texts_encode_as_by_the_tokenizer(tokenizer, monkeypatch):
    rng = np.random.default_rng(5)
    some = [*"abzAZ09 \t\n.,!<|>'_-", "\x1c", "\x85", "é", "́", "ß", "İ", "Σ", "中", "½", "🙂", " ", "'s", "'LL", "<|endoftext|>", "word", "The "]
    rows = ["".join(rng.choice(some, n)) for n in rng.integers(0, 40, 1500)] + ["x" * 300 + "y" * 257 + " " + "é" * 400, "-" * 1000]
    encoder = Encoder(tokenizer_path())
    for at in (0, 700, 0):
        ids, bounds = encoder.encode(pa.array(rows[at:], pa.string()))
        for k, text in enumerate(rows[at:]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fingerprints_share_addresses():
    known, rng = Fingerprints(500), np.random.default_rng(2)
    a, b = rng.integers(0, 8, 500, dtype=np.uint64), np.arange(500, dtype=np.uint64)
    for cut in (slice(0, 1), slice(1, 300), slice(300, 500)):
        known.add(a[cut], b[cut])
    assert known.find(a, b).tolist() == list(range(500))
    assert known.find(a, b + np.uint64(500)).tolist() == [-1] * 500


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 5000, 70000):
        ids = np.minimum(rng.zipf(1.3, n), 49407).astype(np.uint32)
        table_ = rans.Table(rans.frequency_table(np.bincount(ids, minlength=49408)))
        block = rans.encode_block(ids, table_)
        assert (rans.decode_block(block, table_) == ids).all()
    damaged = bytearray(block)
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(damaged), table_)
    skewed = rans.Table(rans.frequency_table(np.array([10**12, 1, 0, 1])))
    ids = np.array([0, 1, 3, 0, 0, 3] * 500, np.uint32)
    assert (rans.decode_block(rans.encode_block(ids, skewed), skewed) == ids).all()


def test_token_files_round_trip(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 3000)
    token_files.write_token_files(table(spark), str(tmp_path / "t"))
    got = token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in texts()), key=lambda i: -1 if i is None else i)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted((i or -1, plain_ids(tokenizer, t, 1).tolist()) for i, t in texts())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == want
    token_files.write_token_files(empty(spark), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_ids_beyond_two_bytes():
    ids = np.array([1, 70000, 3, 4], np.uint32)
    packed = token_files.pack_ids(ids, np.array([0, 2, 2, 4]))
    assert [token_files.unpack_ids(p).tolist() for p in packed.to_pylist()] == [[1, 70000], [], [3, 4]]


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_places_every_id_once_without_padding(spark, tokenizer, window):
    rows = texts()
    got = packing.pack(table(spark).repartition(3), window=window, with_ids=True).collect()
    pieces = {}
    for r in got:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for i, t in rows:
        ids = plain_ids(tokenizer, t, 2).tolist()
        copies = sum(1 for j, u in rows if (j, len(plain_ids(tokenizer, u, 2))) == (i, len(ids)))
        own = sorted(pieces[i, len(ids)])
        assert sum((part for _, part in own), []) == ids or copies > 1
        assert sum(len(part) for _, part in own) == copies * len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0
    assert packing.pack(empty(spark)).count() == 0


def test_least_squares_recipes():
    remainders = np.array([30] * 10 + [34] * 10 + [20] * 6 + [24] * 3 + [7])
    found = packing.recipes(remainders, 64)
    assert all(lengths.sum() == 64 for lengths, _ in found)
    used = sum(len(lengths) * times for lengths, times in found)
    assert used >= 28


def test_all_combinations_and_optimal_counts():
    rng = np.random.default_rng(4)
    lengths, counts = np.unique(rng.integers(1, 200, 900), return_counts=True)
    members = packing.combinations(lengths, 200)
    own = {tuple(sorted(lengths[m[m >= 0]].tolist())) for m in members}
    values = set(lengths.tolist())
    pairs = {(a, 200 - a) for a in values if a <= 100 and 200 - a in values}
    triples = {(a, b, 200 - a - b) for a in values for b in values if a <= b <= 200 - a - b and 200 - a - b in values}
    assert own == pairs | triples and len(own) == len(members)
    solved = packing.least_squares(members, counts.astype(float))
    used = np.zeros(len(lengths))
    for row, x in zip(members, solved):
        for m in row[row >= 0]:
            used[m] += x
    for row, x in zip(members, solved):
        gradient = (used - counts)[row[row >= 0]].sum()
        assert x >= 0 and abs(min(x, gradient)) <= packing.TOLERANCE + 1e-9


def test_least_squares_keeps_more_documents_whole(monkeypatch):
    sizes = np.clip(np.random.default_rng(9).lognormal(6.2, 0.9, 3000).astype(int), 1, 4000)

    def cut_documents():
        packer = packing.Packer(0)
        pieces = [*packer.pack(list(range(len(sizes))), sizes), *packer.finish()]
        return int((np.bincount([p[0] for p in pieces]) > 1).sum())

    solved = cut_documents()
    monkeypatch.setattr(packing, "recipes", lambda remainders, window: [])
    assert solved < 0.9 * cut_documents()
