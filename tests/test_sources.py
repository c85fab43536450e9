"""Files, archives, records and streams on disk."""

import io
import tarfile
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tarnmill import schemas
from tarnmill.operators import catalog
from tarnmill.sources import files, records
from tarnmill.streaming.intake import extract_new_comments


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "org" / "repo" / "pkg").mkdir(parents=True)
    (tmp_path / "org" / "repo" / "a.py").write_bytes(b"# hi \xff there\r\nx = 1\rz = 2\n")
    (tmp_path / "org" / "repo" / "pkg" / "a.py").write_bytes(b"# other\n")
    (tmp_path / "org" / "repo" / "note.txt").write_bytes(b"skip")
    (tmp_path / "stray.py").write_bytes(b"# stray\n")
    return tmp_path


def test_list_and_read(spark, tree):
    listed = files.list_files(spark, str(tree))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in listed.collect()) == ["a.py", "a.py", "stray.py"]
    rows = {r["file_id"]: r for r in files.read_files(spark, str(tree)).collect()}
    assert rows["org/repo/a.py"]["text"] == "# hi  there\nx = 1\nz = 2\n"
    assert rows["org/repo/pkg/a.py"]["repo"] == "org/repo"
    assert [r["file_id"] for r in files.misplaced(files.read_files(spark, str(tree))).collect()] == ["stray.py"]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as archive:
        for name, data in {"r-main/A.PY": b"x", "r-main/b.txt": b"y", "r-main/c.py": b"z"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    kept = files.read_archives(spark, str(tmp_path))
    assert {(r["member"], bytes(r["content"])) for r in kept.collect()} == {("r-main/A.PY", b"x"), ("r-main/c.py", b"z")}
    assert files.read_archives(spark, str(tmp_path), ()).count() == 3
    # a cut-off archive next to it costs one row with the error, not the job
    whole = (tmp_path / "r.tar.gz").read_bytes()
    (tmp_path / "bad.tar.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.tar.gz").write_bytes(b"no archive")
    rows = files.read_archives(spark, str(tmp_path), ()).collect()
    assert sum(r["error"] is None and r["archive"].endswith("/r.tar.gz") for r in rows) == 3
    assert sorted(r["archive"].rsplit("/", 1)[1] for r in rows if r["error"]) == ["bad.tar.gz", "none.tar.gz"]


def test_unread_files_have_a_row(spark, tmp_path):
    for name in ("o/r/a.py", "o/r/b.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\r\n")
    read = files.read_files(spark, str(tmp_path)).where("file_id like '%a.py'")
    unread = files.unread_files(spark, str(tmp_path), read).collect()
    assert len(unread) == 1 and unread[0]["file_id"].endswith("b.py") and unread[0]["error"] == "unreadable"
    assert read.first()["text"] == "x = 1\n"


def test_write_selected_skips_existing(spark, tmp_path):
    out = str(tmp_path / "selected")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "file_id string, text string")
    files.write_selected(rows.where("file_id = 'a'"), out)
    files.write_selected(rows.withColumn("text", F.lit("new")), out)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("a", "1"), ("b", "new")}


def test_records_and_splits(spark, tmp_path):
    row = [("/p", "f.py", 1, [(0, 1, 2, 3)], "o/r")]
    df = spark.createDataFrame(row, schemas.FILE_COMMENTS)
    records.write_records(df, str(tmp_path / "r"))
    assert records.read_records(spark, str(tmp_path / "r"), schemas.FILE_COMMENTS).collect() == df.collect()
    split = spark.createDataFrame([("train", "o/r", "1"), ("test", "o/q", "2")], "split string, repo string, file_id string")
    records.write_splits(split, str(tmp_path / "s"))
    one = records.read_split(spark, str(tmp_path / "s"), "test")
    assert [r["file_id"] for r in one.collect()] == ["2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "t.txt").write_text("b\n\na\n")
    rows = records.read_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(0, "b"), (1, ""), (2, "a")]


@pytest.mark.parametrize("size", ["1", "7", "4096"])
def test_lines_by_byte_ranges(spark, tmp_path, size):
    texts = {"a": "one\r\ntwo\n\n\nfünf 🙂 sechs", "b": "\n", "c": "x" * 40 + "\n" + "y\n" * 9, "d": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = records.read_lines(spark, str(tmp_path))
        assert size == "4096" or lines.rdd.getNumPartitions() > 4
        got = {(r["path"][-1], r["line_no"], r["line"]) for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(name, k, line) for name, text in texts.items() if text for k, line in enumerate(text.removesuffix("\n").split("\n"))}
    assert got == want


def test_archives_are_streamed(tmp_path, monkeypatch):
    """Reading holds one batch: a long archive never lies in memory."""
    from tarnmill.sources import archives

    monkeypatch.setattr(archives, "BYTES_PER_BATCH", 1 << 20)
    with tarfile.open(tmp_path / "long.tar", "w") as archive:
        for k in range(64):
            info = tarfile.TarInfo(f"m{k}.py")
            info.size = 1 << 20
            archive.addfile(info, io.BytesIO(bytes(1 << 20)))
    reader = archives._Reader({"path": str(tmp_path), "pattern": "*.tar"})
    (partition,) = reader.partitions()
    tracemalloc.start()
    sizes = [sum(map(len, batch.column("content").to_pylist())) for batch in reader.read(partition)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [1 << 20] * 64 and peak < 24 << 20


def test_written_folds_read_back(spark, tmp_path):
    rows = [(k % 3, "train" if k % 4 else "valid", "positive" if k % 2 else "negative", f"text {k} é") for k in range(40)]
    df = spark.createDataFrame(rows, "fold int, part string, label string, text string").repartition(3)
    records.write_labelled(df, str(tmp_path / "f"))
    assert sorted(tuple(r) for r in records.read_labelled(spark, str(tmp_path / "f")).collect()) == sorted(rows)


def test_labelled_folds(spark, tmp_path):
    (tmp_path / "c_0.train").write_text("__label__positive a b c\n__label__negative x")
    (tmp_path / "c_0.valid").write_text("__label__negative only\n")
    (tmp_path / "c_12.train").write_text("__label__positive q\n")
    rows = {tuple(r) for r in records.read_labelled(spark, str(tmp_path)).collect()}
    assert rows == {
        (0, "train", "positive", "a b c"),
        (0, "train", "negative", "x"),
        (0, "valid", "negative", "only"),
        (12, "train", "positive", "q"),
    }


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([("w", [1.0, 0.5]), ("v", [0.0, -2.0])], "word string, vector array<float>")
    records.write_vectors(df, str(tmp_path / "v"))
    parts = sorted((tmp_path / "v").glob("part-*"))
    assert parts[0].read_text() == "2 2\n"
    assert {(r["word"], tuple(r["vector"])) for r in records.read_vectors(spark, str(tmp_path / "v")).collect()} == {
        ("w", (1.0, 0.5)),
        ("v", (0.0, -2.0)),
    }


def test_catalog(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"u1": 10, "u2": 20}')
    old = records.read_catalog(spark, str(tmp_path / "old.json"))
    new = spark.createDataFrame([("u2", 25, 1), ("u2", 24, 2), ("u3", 3, 3)], "url string, stars bigint, seq bigint")
    merged = catalog.merge_catalogs(old, new)
    assert {tuple(r) for r in merged.collect()} == {("u1", 10), ("u2", 24), ("u3", 3)}
    assert catalog.resume_bound(merged).first()[0] == 4
    assert catalog.resume_bound(merged, 99).first()[0] == 99
    assert catalog.resume_bound(merged.where("false")).first()[0] == 500000
    assert [r["url"] for r in catalog.repos_in_range(merged, 4, 24).collect()] == ["u2", "u1"]
    records.write_catalog(merged, str(tmp_path / "c"))
    assert records.read_catalog(spark, str(tmp_path / "c")).count() == 3


def test_stream_only_reads_new_files(spark, tree, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")
    out, state = str(work / "out"), str(work / "state")
    extract_new_comments(spark, str(tree), out, state).awaitTermination()
    first = {r["text"] for r in spark.read.parquet(out).collect()}
    assert first == {"hi  there", "other", "stray"}
    (tree / "org" / "repo" / "later.py").write_text("# came later\n")
    extract_new_comments(spark, str(tree), out, state).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["came later", "hi  there", "other", "stray"]


@pytest.mark.parametrize("kind", ["", "gz", "bz2", "xz"])
def test_small_members_cost_their_own_size(tmp_path, monkeypatch, kind):
    """However well an archive is compressed, a read copies at most a buffer."""
    from tarnmill.sources import archives

    with tarfile.open(tmp_path / "many.tar", f"w:{kind}") as archive:
        for k in range(3000):
            info = tarfile.TarInfo(f"m{k}.py")
            info.size = 1000
            archive.addfile(info, io.BytesIO(bytes(1000)))
    most = []
    read = tarfile._Stream._read

    def watched(self, size):
        found = read(self, size)
        most.append(max(len(getattr(self, "buf", b"")), len(getattr(self, "dbuf", b""))))
        return found

    monkeypatch.setattr(tarfile._Stream, "_read", watched)
    reader = archives._Reader({"path": str(tmp_path), "pattern": "*.tar"})
    rows = [row for batch in reader.read(reader.partitions()[0]) for row in batch.to_pylist()]
    assert [row["member"] for row in rows] == [f"m{k}.py" for k in range(3000)] and all(len(row["content"]) == 1000 for row in rows)
    assert max(most) <= 1 << 16


def test_small_files_are_read_once(spark, tmp_path):
    """Only a file that is cut into ranges needs a pass that counts its lines."""
    want = set()
    for k, lines in enumerate([["a", "", "b"], ["c"], [f"line {i} " + "x" * 50 for i in range(4000)]]):
        (tmp_path / f"f{k}.txt").write_text("\n".join(lines) + "\n")
        want |= {(f"f{k}.txt", i, line) for i, line in enumerate(lines)}
    limits = {"spark.sql.files.openCostInBytes": "1k", "spark.sql.files.maxPartitionBytes": "50000"}
    before = {name: spark.conf.get(name) for name in limits}
    counted = []
    stored = records.stored

    def watched(df, name="table"):
        out = stored(df, name)
        if name == "ranges":
            counted.extend(row["path"].rsplit("/", 1)[1] for row in out.collect())
        return out

    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        records.stored = watched
        rows = records.read_lines(spark, str(tmp_path)).collect()
    finally:
        records.stored = stored
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {(r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in rows} == want and len(rows) == len(want)
    assert set(counted) == {"f2.txt"} and len(counted) > 1
