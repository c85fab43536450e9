"""Deduplication, splits, tokens and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from tarnmill.functions import arrays
from tarnmill.markers import BEGIN_COMMENT
from tarnmill.operators import dedup, packing, repeats, splits, subword, tokens, vocab
from tarnmill.operators.prefix import running_total
from tarnmill.session import cut_lineage
from tarnmill.sources.records import write_csv

QUERIES, ORACLES, query = s.registry()

_HASHES = f"""{s.FILES},
kept AS (SELECT file_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS t FROM files),
chars AS (SELECT file_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM kept WHERE length(t) >= 4),
grams AS (
  SELECT file_id, c || lead(c, 1) OVER w || lead(c, 2) OVER w || lead(c, 3) OVER w AS g
  FROM chars WINDOW w AS (PARTITION BY file_id ORDER BY i)
  UNION ALL SELECT file_id, t FROM kept WHERE length(t) < 4),
counted AS (SELECT file_id, g, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY file_id, g),
hashed AS (SELECT file_id, n, CAST('0x' || substr(md5(g), 17, 16) AS UBIGINT) AS h FROM counted),
votes AS (SELECT file_id, {', '.join(f'sum(CASE WHEN (h >> {k}) & 1 = 1 THEN n ELSE -n END) > 0 AS b{k}' for k in range(64))} FROM hashed GROUP BY file_id),
hashes AS (
  SELECT file_id, CAST({' + '.join(f"CASE WHEN b{k} THEN {2**k if k < 63 else -(2**63)}::HUGEINT ELSE 0 END" for k in range(64))} AS BIGINT) AS hash
  FROM votes),
meta AS (
  SELECT f.file_id, repo, len(lines) AS num_lines, len(list_filter(lines, lambda x: length(x) % 5 = 0)) AS num_comments, hash
  FROM files f JOIN hashes h ON f.file_id = h.file_id)"""

_UNIQUE = f"""{_HASHES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_id) AS k, count(*) OVER (PARTITION BY hash) AS copies FROM meta),
uniq AS (SELECT * FROM ranked WHERE k = 1)"""

_SPLIT = f"""{_UNIQUE},
repo_sums AS (SELECT repo, count(*) AS files, CAST(sum(num_lines) AS BIGINT) AS num_lines, CAST(sum(num_comments) AS BIGINT) AS num_comments FROM uniq GROUP BY repo),
lines_total AS (SELECT CAST(sum(num_lines) AS BIGINT) AS l FROM repo_sums),
budget1 AS (SELECT l, CAST(floor(CAST(0.2 AS DOUBLE) * l) AS BIGINT) AS ex FROM lines_total),
budget2 AS (SELECT *, CAST(floor(CAST(0.2 AS DOUBLE) * (l - ex)) AS BIGINT) AS te FROM budget1),
budgets AS (SELECT ex, te, CAST(floor(CAST(0.8 AS DOUBLE) * (l - ex - te)) AS BIGINT) AS tr FROM budget2),
ordered AS (
  SELECT *, coalesce(sum(num_lines) OVER (ORDER BY md5('RANDOMSEED' || repo) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM repo_sums),
first_cut AS (SELECT coalesce(sum(num_lines), 0) AS e FROM ordered, budgets WHERE c <= ex),
second_cut AS (SELECT coalesce(sum(num_lines), 0) AS t FROM ordered, budgets, first_cut WHERE c <= ex OR c - e <= te),
assigned AS (
  SELECT repo, files, num_lines, num_comments,
         CASE WHEN c <= ex THEN 'excludes' WHEN c - e <= te THEN 'test' WHEN c - t <= tr THEN 'train' ELSE 'validation' END AS split
  FROM ordered, budgets, first_cut, second_cut)"""


def _meta(spark, sf):
    comments = F.size(F.filter("lines", s.is_comment))
    return s.files(spark, sf).select(
        "file_id", "repo", F.size("lines").alias("num_lines"), comments.alias("num_comments"), dedup.simhash(F.col("text")).alias("hash")
    )


def _unique(spark, sf):
    # hashing reads whole texts, so its small result is kept for all later readers
    return cut_lineage(dedup.unique_files(_meta(spark, sf)))


def _assigned(spark, sf):
    unique = _unique(spark, sf)
    return unique, splits.assign_repos(splits.repo_totals(unique), splits.line_budgets(splits.corpus_totals(unique)))


@query("file_line_counts", f"WITH {s.FILES} SELECT file_id, CAST(len(lines) AS INTEGER) AS num_lines, CAST(len(list_filter(lines, lambda x: length(x) % 5 = 0)) AS INTEGER) AS num_comments FROM files")
def file_line_counts(spark, sf):
    return s.files(spark, sf).select("file_id", F.size("lines").alias("num_lines"), F.size(F.filter("lines", s.is_comment)).alias("num_comments"))


@query("file_hashes", f"WITH {_HASHES} SELECT file_id, hash FROM hashes")
def file_hashes(spark, sf):
    return s.files(spark, sf).select("file_id", dedup.simhash(F.col("text")).alias("hash"))


@query("unique_files", f"WITH {_UNIQUE} SELECT file_id, repo, hash, copies FROM uniq")
def unique_files(spark, sf):
    return _unique(spark, sf).select("file_id", "repo", "hash", "copies")


@query("repo_totals", f"WITH {_SPLIT} SELECT repo, files, num_lines, num_comments FROM repo_sums")
def repo_totals(spark, sf):
    return splits.repo_totals(_unique(spark, sf))


@query(
    "corpus_totals",
    f"""WITH {_UNIQUE} SELECT count(*) AS total_files, CAST(sum(num_lines) AS BIGINT) AS total_lines,
    CAST(sum(num_comments) AS BIGINT) AS total_comments, CAST(sum(copies - 1) AS BIGINT) AS duplicates FROM uniq""",
)
def corpus_totals(spark, sf):
    return splits.corpus_totals(_unique(spark, sf))


@query("line_budgets", f"WITH {_SPLIT} SELECT ex AS exclude_lines, te AS test_lines, tr AS train_lines FROM budgets")
def line_budgets(spark, sf):
    return splits.line_budgets(splits.corpus_totals(_unique(spark, sf)))


@query("shuffled_repos", f"WITH {_SPLIT} SELECT repo, row_number() OVER (ORDER BY md5('RANDOMSEED' || repo)) - 1 AS position FROM repo_sums")
def shuffled_repos(spark, sf):
    repos = splits.repo_totals(_unique(spark, sf)).withColumn("order_key", splits.shuffle_key(F.col("repo")))
    placed = running_total(repos, ["order_key", "repo"], {"position": F.lit(1)})
    return placed.select("repo", "position")


@query("repo_splits", f"WITH {_SPLIT} SELECT repo, split, num_lines FROM assigned")
def repo_splits(spark, sf):
    return _assigned(spark, sf)[1].select("repo", "split", "num_lines")


@query("split_files", f"WITH {_SPLIT} SELECT split, u.repo, file_id FROM uniq u JOIN assigned a ON u.repo = a.repo")
def split_files(spark, sf):
    unique, assigned = _assigned(spark, sf)
    return splits.split_files(unique, assigned)


@query(
    "split_statistics",
    f"""WITH {_SPLIT}, names AS (SELECT * FROM (VALUES ('excludes'), ('test'), ('train'), ('validation')) AS v(split))
    SELECT upper(n.split[1]) || n.split[2:] AS split, CAST(coalesce(sum(files), 0) AS BIGINT) AS files,
           CAST(coalesce(sum(num_lines), 0) AS BIGINT) AS lines, CAST(NULL AS BIGINT) AS duplicates
    FROM names n LEFT JOIN assigned a ON n.split = a.split GROUP BY n.split
    UNION ALL SELECT 'Total', CAST(sum(files) AS BIGINT), CAST(sum(num_lines) AS BIGINT), (SELECT CAST(sum(copies - 1) AS BIGINT) FROM uniq) FROM assigned""",
)
def split_statistics(spark, sf):
    unique, assigned = _assigned(spark, sf)
    return splits.split_statistics(assigned, dedup.duplicate_count(unique))


@query("split_statistics_csv", ORACLES["split_statistics"])
def split_statistics_csv(spark, sf):
    folder = s.scratch(spark)
    write_csv(split_statistics(spark, sf), folder)
    return spark.read.option("header", True).schema("split string, files bigint, lines bigint, duplicates bigint").csv(folder)


# ---------------------------------------------------------------- tokens


@query("serialised_tokens", f"WITH {s.CODE} SELECT file_id, md5(string_agg(array_to_string(toks, ' '), chr(10) ORDER BY line_no)) AS digest FROM code GROUP BY file_id")
def serialised_tokens(spark, sf):
    return s.code_lines(spark, sf).select("file_id", F.md5(arrays.join_lines(F.col("lines"))).alias("digest"))


@query("comment_line_indexes", f"WITH {s.CODE} SELECT file_id, coalesce(string_agg(CASE WHEN list_contains(toks, '<COMMENT>') THEN CAST(line_no - 1 AS VARCHAR) END, ' ' ORDER BY line_no), '') AS positions FROM code GROUP BY file_id")
def comment_line_indexes(spark, sf):
    lines = s.code_lines(spark, sf).withColumn("positions", arrays.lines_containing(F.col("lines"), BEGIN_COMMENT))
    return lines.select("file_id", s.text_of("positions").alias("positions"))


@query("reserved_symbols", f"SELECT piece, CAST(id AS INTEGER) AS id FROM (WITH {s.LINES},{s.VOCABULARY} SELECT piece, id FROM vocab) v")
def reserved_symbols(spark, sf):
    return s.vocabulary(spark, sf)


@query("framed_files", f"WITH {s.TOKENS} SELECT file_id, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM tok GROUP BY file_id")
def framed_files(spark, sf):
    return tokens.frame_files(s.code_lines(spark, sf)).select("file_id", s.text_of("tokens").alias("tokens"))


@query(
    "tokens_of_split",
    f"WITH {_SPLIT}, {s.TOKENS[len(s.FILES) + 2:]} SELECT t.file_id, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM tok t WHERE file_id IN (SELECT file_id FROM uniq u JOIN assigned a ON u.repo = a.repo WHERE split = 'train') GROUP BY t.file_id",
)
def tokens_of_split(spark, sf):
    unique, assigned = _assigned(spark, sf)
    wanted = splits.split_files(unique, assigned).where(F.col("split") == "train")
    framed = tokens.frame_files(s.code_lines(spark, sf).join(wanted, "file_id", "left_semi"))
    return framed.select("file_id", s.text_of("tokens").alias("tokens"))


def _ids(spark, sf, vocabulary=None):
    return tokens.pieces_to_ids(s.token_files(spark, sf), vocabulary or s.vocabulary(spark, sf), drop=["tokens"])


@query("piece_ids", f"WITH {s.IDS} SELECT file_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM ids GROUP BY file_id")
def piece_ids(spark, sf):
    return _ids(spark, sf).select("file_id", s.text_of("ids").alias("ids"))


@query("id_pieces", f"WITH {s.IDS} SELECT file_id, string_agg(piece, ' ' ORDER BY pos) AS pieces FROM ids JOIN vocab USING (id) GROUP BY file_id")
def id_pieces(spark, sf):
    vocabulary = s.vocabulary(spark, sf)
    back = tokens.ids_to_pieces(_ids(spark, sf, vocabulary).select("file_id", "ids"), vocabulary, "ids", "pieces", ["ids"])
    return back.select("file_id", s.text_of("pieces").alias("pieces"))


@query("decoded_pieces", f"WITH {s.LINES} SELECT file_id, CAST(line_no - 1 AS INTEGER) AS line_no, trim(array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ' ')) AS text FROM line_rows")
def decoded_pieces(spark, sf):
    lines = s.files(spark, sf).select("file_id", F.posexplode("lines").alias("line_no", "line"))
    marked = F.transform(s.words(F.col("line")), lambda w: F.concat(F.lit("▁"), w))
    return lines.select("file_id", "line_no", tokens.decode_pieces(marked).alias("text"))


@query(
    "maximal_repeats",
    f"""WITH {s.LINES}, words AS (
      SELECT w, count(*) AS n FROM (SELECT unnest(string_split(line, ' ')) AS w FROM line_rows) WHERE w <> '' GROUP BY w),
    starts AS (SELECT w, n, unnest(generate_series(1, len(w))) AS i FROM words),
    cuts AS (SELECT w[i:k] AS piece, n FROM (SELECT w, n, i, unnest(generate_series(i, len(w))) AS k FROM starts)),
    counts AS (SELECT piece, sum(n) AS n FROM cuts GROUP BY piece HAVING sum(n) > 1),
    grown AS (SELECT left(piece, len(piece) - 1) AS piece, n FROM counts UNION SELECT piece[2:], n FROM counts)
    SELECT piece, CAST(n AS BIGINT) AS n FROM (SELECT piece, n FROM counts WHERE len(piece) > 1 EXCEPT SELECT piece, n FROM grown)""",
)
def maximal_repeats(spark, sf):
    split = s.files(spark, sf).select(F.explode("lines").alias("line")).select(F.explode(s.words(F.col("line"))).alias("word"))
    return repeats.maximal_repeats(split.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("fitted_vocabulary")
def fitted_vocabulary(spark, sf):
    return vocab.fit_vocabulary(vocab.word_counts(s.files(spark, sf)))


@query("encoded_lines")
def encoded_lines(spark, sf):
    fitted = vocab.fit_vocabulary(vocab.word_counts(s.files(spark, sf)))
    encoded = s.code_lines(spark, sf).select("file_id", F.transform("lines", lambda line: F.array_join(line, " ")).alias("lines"))
    pieces = encoded.withColumn("lines", subword.encode_lines(F.col("lines"), vocab.piece_scores(fitted)))
    return tokens.frame_files(pieces).select("file_id", F.size("tokens").alias("num_pieces"), F.md5(s.text_of("tokens")).alias("digest"))


# ---------------------------------------------------------------- packing

_PACK = """, flat AS (SELECT id, row_number() OVER (ORDER BY {order}, pos) - 1 AS place, count(*) OVER () AS total FROM ids),
placed AS (SELECT id, place, CAST(floor(place / 512) AS BIGINT) AS block_id, CAST(floor(total * CAST({fraction} AS DOUBLE)) AS BIGINT) AS kept FROM flat)
SELECT block_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY place) AS input_ids FROM placed
WHERE place < kept - kept % 512 GROUP BY block_id"""


def _stored_ids(spark, sf):
    """The id data set is a stored table between stages; packing reads it twice."""
    return cut_lineage(_ids(spark, sf).select("file_id", "ids"))


def _packed(blocks):
    return blocks.select("block_id", s.text_of("input_ids").alias("input_ids"))


@query("packed_blocks", f"WITH {s.IDS}" + _PACK.format(order="file_id", fraction="1.0"))
def packed_blocks(spark, sf):
    return _packed(packing.pack_blocks(_stored_ids(spark, sf)))


@query("packed_fraction", f"WITH {s.IDS}" + _PACK.format(order="file_id", fraction="0.37"))
def packed_fraction(spark, sf):
    return _packed(packing.pack_blocks(_stored_ids(spark, sf), fraction=0.37))


@query("packed_epoch", f"WITH {s.IDS}" + _PACK.format(order="md5('RANDOMSEED:2:' || file_id), file_id", fraction="1.0"))
def packed_epoch(spark, sf):
    return _packed(packing.pack_blocks(_stored_ids(spark, sf), epoch=2))
