"""Scans, sinks, keys, filters, limits and the repository catalog."""

from __future__ import annotations

import io
import tarfile
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from checks import standins as s
from tarnmill import schemas
from tarnmill.functions import paths
from tarnmill.operators import catalog, prefix
from tarnmill.operators.tokens import pieces_to_ids
from tarnmill.sources import files as file_source
from tarnmill.sources import records
from tarnmill.sources.archives import located

QUERIES, ORACLES, query = s.registry()


@query("decoded_text", "SELECT doc_id AS file_id, md5(text) AS digest FROM documents")
def decoded_text(spark, sf):
    raw = s.files(spark, sf).select("file_id", F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF"))).alias("content"))
    return raw.select("file_id", F.md5(file_source.decode(F.col("content"))).alias("digest"))


@query(
    "json_records",
    f"""WITH {s.FILES} SELECT path AS file_path, CAST(len(lines) AS INTEGER) AS num_comments, repo,
    array_to_string(list_transform(lines, lambda x, i: (i - 1) || ':0:' || (i - 1) || ':' || length(x)), ',') AS positions FROM files""",
)
def json_records(spark, sf):
    folder = s.scratch(spark)

    def span(line, i):
        return F.struct(i.alias("srow"), F.lit(0).alias("scol"), i.alias("erow"), F.length(line).alias("ecol"))

    positions = F.transform("lines", span).alias("positions")
    lines = s.files(spark, sf).select(F.col("path").alias("file_path"), F.size("lines").alias("num_comments"), positions, "repo")
    records.write_records(lines, folder)
    shown = F.array_join(F.transform("positions", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("srow", "scol", "erow", "ecol")])), ",")
    read = records.read_records(spark, folder, schemas.FILE_COMMENTS)
    return read.select("file_path", "num_comments", "repo", shown.alias("positions"))


@query(
    "split_partition",
    f"WITH {s.FILES} SELECT file_id, repo FROM files WHERE repo LIKE 'src1%'",
)
def split_partition(spark, sf):
    folder = s.scratch(spark)
    named = F.when(F.col("repo").startswith("src1"), "train").otherwise("validation")
    records.write_splits(s.files(spark, sf).select(named.alias("split"), "repo", "file_id"), folder)
    return records.read_split(spark, folder, "train").select("file_id", "repo")


def _text_files(spark, sf):
    """One text file for each document, in a partition folder for each task."""
    folder = s.scratch(spark)

    def write(batches):
        system, root = located(folder)
        own = f"{root}/task={TaskContext.get().partitionId()}"
        system.create_dir(own, recursive=True)
        # documents with one id keep a file each, and a task that runs again writes the same names
        seen = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                with system.open_output_stream(f"{own}/doc={doc}_{seen[doc]}.txt") as stream:
                    stream.write(f"{text or ''}\n".encode())
                seen[doc] += 1
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    s.files(spark, sf).select(F.col("file_id").alias("doc"), "text").mapInArrow(write, "done bigint").write.format("noop").mode("overwrite").save()
    return folder


def _doc_of(path):
    return F.regexp_extract(path, "/doc=([0-9]+)_[0-9]+", 1).cast("bigint").alias("file_id")


@query("lines_in_order", f"WITH {s.LINES} SELECT file_id, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM line_rows")
def lines_in_order(spark, sf):
    return records.read_lines(spark, _text_files(spark, sf)).select(_doc_of(F.col("path")), "line_no", "line")


def _tar_files(spark, sf):
    """A folder with a tar archive from each task: every document, and a note beside it."""
    folder = s.scratch(spark)

    def pack(batches):
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/a{TaskContext.get().partitionId()}.tar.gz", compression="gzip") as stream:
            with tarfile.open(fileobj=stream, mode="w|") as archive:
                for batch in batches:
                    for doc, text in zip(batch.column("file_id").to_pylist(), batch.column("text").to_pylist()):
                        for name, content in ((f"r/{doc}.PY", (text or "").encode()), (f"r/{doc}.txt", b"note")):
                            info = tarfile.TarInfo(name)
                            info.size = len(content)
                            archive.addfile(info, io.BytesIO(content))
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

    s.files(spark, sf).select("file_id", "text").mapInArrow(pack, "done bigint").write.format("noop").mode("overwrite").save()
    return folder


@query("archive_members", "SELECT doc_id AS file_id, md5(coalesce(text, '')) AS digest FROM documents")
def archive_members(spark, sf):
    found = file_source.read_archives(spark, _tar_files(spark, sf))
    return found.select(F.regexp_extract("member", r"/(\d+)\.PY$", 1).cast("bigint").alias("file_id"), F.md5("content").alias("digest"))


_FOLDS = f"""WITH {s.PREDICTIONS}, thirds AS (SELECT unnest([0, 1, 2]) AS k)
  SELECT CAST(k AS INTEGER) AS fold, CASE WHEN (file_id + k) % 5 = 0 THEN 'valid' ELSE 'train' END AS part, label, file_id FROM predictions, thirds"""


def _folds(spark, sf):
    rows = s.predictions(spark, sf).select("file_id", "label").withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    part = F.when((F.col("file_id") + F.col("fold")) % 5 == 0, "valid").otherwise("train")
    return rows.select("fold", part.alias("part"), "label", F.concat(F.lit("doc "), F.col("file_id").cast("string")).alias("text"))


@query("labelled_folds", f"SELECT fold, part, label, 'doc ' || file_id AS text FROM ({_FOLDS}) f")
def labelled_folds(spark, sf):
    folder = s.scratch(spark)
    records.write_labelled(_folds(spark, sf), folder)
    return records.read_labelled(spark, folder)


@query("labelled_counts", f"SELECT fold, part, label, count(*) AS n FROM ({_FOLDS}) f GROUP BY fold, part, label")
def labelled_counts(spark, sf):
    folder = s.scratch(spark)
    records.write_labelled(_folds(spark, sf), folder)
    return records.read_labelled(spark, folder).groupBy("fold", "part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("listed_files", "SELECT doc_id AS file_id, CAST(strlen(text) + 1 AS BIGINT) AS length FROM documents")
def listed_files(spark, sf):
    return file_source.list_files(spark, _text_files(spark, sf), "*.txt").select(_doc_of(F.col("path")), "length")


@query("files_as_text", "SELECT doc_id AS file_id, md5(replace(text, chr(13), chr(10)) || chr(10)) AS digest FROM documents")
def files_as_text(spark, sf):
    read = file_source.read_files(spark, _text_files(spark, sf), "*.txt")
    return read.select(_doc_of(F.concat(F.lit("/"), "file_id")), F.md5("text").alias("digest"))


@query(
    "vector_text",
    "SELECT 'v' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings",
)
def vector_text(spark, sf):
    folder = s.scratch(spark)
    vectors = s.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    records.write_vectors(vectors, folder)
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return records.read_vectors(spark, folder).select("word", F.size("vector").alias("dim"), F.round(total, 5).alias("total"))


@query("id_table", f"WITH {s.IDS} SELECT file_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM ids GROUP BY file_id")
def id_table(spark, sf):
    folder = s.scratch(spark)
    pieces_to_ids(s.token_files(spark, sf), s.vocabulary(spark, sf), drop=["tokens"]).select("file_id", "ids").write.parquet(folder)
    return spark.read.parquet(folder).select("file_id", s.text_of("ids").alias("ids"))


@query("repo_of_path", f"WITH {s.FILES} SELECT file_id, string_split(path, '/')[3] || '/' || string_split(path, '/')[4] AS repo, substr(path, 7) AS filename FROM files")
def repo_of_path(spark, sf):
    located = s.files(spark, sf).select("file_id", paths.relative_path(F.col("path"), "/data").alias("filename"))
    return located.select("file_id", paths.repo_of_path(F.col("filename")).alias("repo"), "filename")


@query("repo_of_url", f"WITH {s.REPOS} SELECT seq, string_split(url, '/')[4] AS org, string_split(url, '/')[5] AS name FROM repos")
def repo_of_url(spark, sf):
    return s.repos(spark, sf).select("seq", F.inline(F.array(paths.repo_of_url(F.col("url")))))


@query(
    "output_paths",
    f"WITH {s.FILES} SELECT file_id, '/out/' || substr(path, 7) AS new_path, regexp_replace(substr(path, 7), '\\.py$', '.txt') AS token_file FROM files",
)
def output_paths(spark, sf):
    relative = paths.relative_path(F.col("path"), "/data")
    return s.files(spark, sf).select("file_id", paths.rebased_path(relative, "/out/").alias("new_path"), paths.token_file_name(relative).alias("token_file"))


@query("limited_rows", "SELECT doc_id AS file_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def limited_rows(spark, sf):
    docs = s.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "n_chars")
    return catalog.first_rows(docs, ["file_id"], 100)


@query(
    "first_fraction",
    "SELECT doc_id AS file_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k <= floor(n * CAST(0.3 AS DOUBLE))",
)
def first_fraction(spark, sf):
    docs = s.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"))
    return prefix.take_fraction(docs, ["file_id"], 0.3)


@query("pending_files", "SELECT doc_id AS file_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_files(spark, sf):
    docs = s.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"))
    done = s.table(spark, sf, "labels").select(F.col("doc_id").alias("file_id"))
    return catalog.pending(docs, done, ["file_id"])


@query(
    "selected_files",
    "SELECT doc_id AS file_id, md5(text) AS digest FROM documents",
)
def selected_files(spark, sf):
    folder = s.scratch(spark)
    rows = s.files(spark, sf).select("file_id", "text")
    labelled = s.table(spark, sf, "labels").select(F.col("doc_id").alias("file_id"))
    file_source.write_selected(rows.join(labelled, "file_id", "left_semi"), folder)
    file_source.write_selected(rows, folder)
    return spark.read.parquet(folder).select("file_id", F.md5("text").alias("digest"))


@query("upserted_repos", f"WITH {s.REPOS} SELECT url, arg_max(stars, seq) AS stars FROM repos GROUP BY url")
def upserted_repos(spark, sf):
    return catalog.upsert_repos(s.repos(spark, sf))


_MERGED = f"""WITH {s.REPOS},
old AS (SELECT url, arg_max(stars, seq) AS stars FROM repos WHERE NOT secure GROUP BY url),
new AS (SELECT url, arg_max(stars, seq) AS stars FROM repos WHERE secure GROUP BY url),
merged AS (SELECT coalesce(new.url, old.url) AS url, coalesce(new.stars, old.stars) AS stars FROM old FULL JOIN new ON old.url = new.url)"""


def _merged(spark, sf):
    """Pages without TLS as the existing catalog, those with it as the later crawl."""
    items = s.repos(spark, sf)
    return catalog.merge_catalogs(catalog.upsert_repos(items.where("NOT secure")), items.where("secure"))


@query("merged_catalog", f"{_MERGED} SELECT url, stars FROM merged")
def merged_catalog(spark, sf):
    return _merged(spark, sf)


@query("resume_bound", f"{_MERGED} SELECT min(stars) + 1 AS max_stars FROM merged")
def resume_bound(spark, sf):
    return catalog.resume_bound(_merged(spark, sf))


@query("repos_in_range", f"{_MERGED} SELECT url, stars FROM merged WHERE stars BETWEEN 1000 AND 5000 ORDER BY stars DESC, url")
def repos_in_range(spark, sf):
    return catalog.repos_in_range(_merged(spark, sf), 1000, 5000)


@query("catalog_file", f"{_MERGED} SELECT url, stars FROM merged")
def catalog_file(spark, sf):
    folder = s.scratch(spark)
    records.write_catalog(_merged(spark, sf), folder)
    return records.read_catalog(spark, folder)
