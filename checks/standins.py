"""Inputs of the operators, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.markers import BEGIN_COMMENT, DEDENT, END_COMMENT, INDENT, reserved_symbols
from tarnmill.operators.prefix import with_position
from tarnmill.operators.sequences import comment_pairs
from tarnmill.operators.tokens import frame_lines, reserved_table
from tarnmill.session import checkpoint_dir, cut_lineage, spread



def registry():
    """Two dictionaries and the decorator that files a query and its SQL in them."""
    queries, oracles = {}, {}

    def query(name: str, sql: str | None = None):
        def add(function):
            queries[name] = function
            if sql:
                oracles[name] = sql
            return function

        return add

    return queries, oracles, query


# ---------------------------------------------------------------- Spark


def table(spark: SparkSession, sf: str, name: str, *keys: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, *keys) if keys else df


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id")
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), path.alias("path"), "text", F.split("text", "\n").alias("lines")
    )


def is_comment(line: Column) -> Column:
    return F.length(line) % 5 == 0


def words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Files as lines of tokens: every line whose length divides by five is a comment."""

    def tokens(line: Column) -> Column:
        marked = F.concat(F.array(F.lit(BEGIN_COMMENT)), words(line), F.array(F.lit(END_COMMENT)))
        return F.when(is_comment(line), marked).otherwise(words(line))

    return files(spark, sf).select("file_id", "repo", F.transform("lines", tokens).alias("lines"))


def token_files(spark: SparkSession, sf: str) -> DataFrame:
    # split() always yields a line, so no file is empty and none needs filtering
    return code_lines(spark, sf).select("file_id", frame_lines(F.col("lines")).alias("tokens"))


def function_files(spark: SparkSession, sf: str) -> DataFrame:
    """Token files in which every sixth line, from the second on, opens a function whose
    body lasts until the third line after it."""

    def tokens(line: Column, i: Column) -> Column:
        mark = (
            F.when(i % 6 == 1, F.array(F.lit("▁def")))
            .when(i % 6 == 2, F.array(F.lit(INDENT)))
            .when(i % 6 == 4, F.array(F.lit(DEDENT)))
            .otherwise(F.array().cast("array<string>"))
        )
        body = F.concat(F.array(F.lit(BEGIN_COMMENT)), words(line), F.array(F.lit(END_COMMENT)))
        return F.concat(mark, F.when(is_comment(line), body).otherwise(words(line)))

    return files(spark, sf).select("file_id", frame_lines(F.transform("lines", tokens)).alias("tokens"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Reserved symbols, then all words seen three times or more, most frequent first."""
    counted = (
        files(spark, sf)
        .select(F.explode("lines").alias("line"))
        .select(F.explode(words(F.col("line"))).alias("piece"))
        .groupBy("piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 3")
        .withColumn("rarity", -F.col("n"))
    )
    # a table of distinct words, read several times below
    numbered = with_position(cut_lineage(counted), ["rarity", "piece"])
    learned = numbered.select("piece", (F.col("position") + len(reserved_symbols())).cast("int").alias("id"))
    return reserved_table(spark).unionByName(learned)


def lexed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as lexical tokens. By line length modulo five: 0 and 1 comment lines, 2 code
    and a comment, 3 code, 4 a blank line."""

    def token(kind: str, row: Column, line: Column, start: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            line.alias("text"),
            (row + 1).cast("int").alias("srow"),
            start.cast("int").alias("scol"),
            (row + 1).cast("int").alias("erow"),
            F.length(line).alias("ecol"),
        )

    def tokens(line: Column, row: Column) -> Column:
        m = F.length(line) % 5
        code = token("CODE", row, line, F.lit(0))
        comment = token("COMMENT", row, line, m)
        nl, newline = token("NL", row, line, F.lit(0)), token("NEWLINE", row, line, F.lit(0))
        return (
            F.when(m <= 1, F.array(comment, nl))
            .when(m == 2, F.array(code, comment, newline))
            .when(m == 3, F.array(code, newline))
            .otherwise(F.array(nl))
        )

    return files(spark, sf).select("file_id", "repo", "path", "lines", F.flatten(F.transform("lines", tokens)).alias("tokens"))


def repos(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl results: repository url from the page's host, stars from its length."""
    pages = table(spark, sf, "pages", "page_id")
    host = F.get(F.split("url", "/"), F.lit(2))
    return pages.select(
        F.concat_ws("/", F.lit("https:"), F.lit(""), F.lit("code.example"), F.get(F.split(host, r"\."), F.lit(0)), host).alias("url"),
        F.length("html").cast("bigint").alias("stars"),
        F.col("page_id").alias("seq"),
        F.col("url").startswith("https:").alias("secure"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a made-up but deterministic score per document."""
    docs = table(spark, sf, "documents", "doc_id").join(table(spark, sf, "labels"), "doc_id")
    score = ((F.col("n_chars") * 7 % 100) / F.lit(100.0)).alias("score")
    rows = docs.select("doc_id", "source", "text", "quality", score)
    positive = F.col("score") >= 0.5
    return rows.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo"),
        "text",
        (F.col("doc_id") % 3).cast("int").alias("fold"),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"),
        F.when(positive, "positive").otherwise("negative").alias("predicted_label"),
        F.when(positive, F.col("score")).otherwise(1 - F.col("score")).alias("prob"),
    )


def scored_comments(spark: SparkSession, sf: str) -> DataFrame:
    """One scored comment per line of the documents."""
    lines = files(spark, sf).select("file_id", F.posexplode("lines").alias("block_no", "text"))
    score = F.length("text") * 37 % 10007 / F.lit(10007.0)
    return lines.select(
        "file_id",
        "block_no",
        F.when(F.length("text") % 3 == 0, "positive").otherwise("negative").alias("label"),
        score.alias("prob"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return comment_pairs(token_files(spark, sf))


def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """An assistant turn as prediction, the next assistant turn as target."""
    turns = (
        table(spark, sf, "conversations", "conv_id", "turn")
        .where(F.col("role") == "assistant")
        .select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    )
    predicted = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("hypothesis")
    )
    target = turns.select("conv_id", "turn", F.col("text").alias("reference"))
    # (conv_id, turn) is unique on both sides, so no key can be hot
    return predicted.join(target, ["conv_id", "turn"]).select("pair_id", "hypothesis", "reference")


def text_of(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), " ")


# ---------------------------------------------------------------- SQL

FILES = """files AS (
  SELECT doc_id AS file_id, source AS repo, '/data/' || source || '/' || lang || '/doc_' || doc_id || '.py' AS path,
         text, string_split(text, chr(10)) AS lines
  FROM documents)"""

LINES = f"""{FILES},
line_rows AS (SELECT file_id, repo, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM files)"""

_WORDS = "list_filter(string_split(line, ' '), lambda w: w <> '')"

CODE = f"""{LINES},
code AS (
  SELECT file_id, repo, line_no, line, length(line) % 5 = 0 AS is_comment,
         CASE WHEN length(line) % 5 = 0 THEN ['<COMMENT>'] || {_WORDS} || ['</COMMENT>'] ELSE {_WORDS} END AS toks
  FROM line_rows)"""


def _token_rows(source: str) -> str:
    return f"""
parts AS (
  SELECT file_id, line_no, unnest(toks || ['<EOL>']) AS tok, generate_subscripts(toks || ['<EOL>'], 1) AS j FROM {source}
  UNION ALL SELECT file_id, 0, '<BOF>', 0 FROM files
  UNION ALL SELECT file_id, 1000000000, '<EOF>', 0 FROM files),
tok AS (
  SELECT file_id, line_no, tok, row_number() OVER (PARTITION BY file_id ORDER BY line_no, j) - 1 AS pos FROM parts)"""


TOKENS = f"{CODE},{_token_rows('code')}"

FUNCTIONS = f"""{CODE},
shaped AS (
  SELECT file_id, line_no,
         CASE (line_no - 1) % 6 WHEN 1 THEN ['▁def'] WHEN 2 THEN ['<INDENT>'] WHEN 4 THEN ['<DEDENT>'] ELSE [] END || toks AS toks
  FROM code),{_token_rows('shaped')}"""

_RESERVED = ", ".join(f"('{piece}', {i})" for i, piece in enumerate(reserved_symbols()))

VOCABULARY = f"""
counted AS (
  SELECT piece, count(*) AS n FROM (SELECT unnest({_WORDS}) AS piece FROM line_rows) GROUP BY piece HAVING count(*) >= 3),
vocab AS (
  SELECT * FROM (VALUES {_RESERVED}) AS r(piece, id)
  UNION ALL SELECT piece, row_number() OVER (ORDER BY n DESC, piece) + {len(reserved_symbols()) - 1} FROM counted)"""

IDS = f"""{TOKENS},{VOCABULARY},
ids AS (SELECT file_id, pos, tok, coalesce(id, 0) AS id FROM tok LEFT JOIN vocab ON tok = piece)"""

PAIRS = """
eols AS (
  SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY file_id) AS total
  FROM tok WHERE tok = '<EOL>'),
ends AS (
  SELECT t.file_id, t.pos, row_number() OVER (PARTITION BY t.file_id ORDER BY t.pos) - 1 AS comment_no, e.k, e.total
  FROM tok t JOIN eols e ON t.file_id = e.file_id AND e.pos = t.pos + 1 WHERE t.tok = '</COMMENT>'),
bounds AS (
  SELECT n.file_id, n.comment_no, n.pos, greatest(n.pos + 2 - 432, 0) AS lo, n.pos + 2 AS cut,
         CASE WHEN n.k < n.total THEN e.pos + 1 ELSE n.pos + 2 END AS hi
  FROM ends n LEFT JOIN eols e ON e.file_id = n.file_id AND e.k = least(n.k + 2, n.total)),
gated AS (SELECT * FROM bounds WHERE hi - cut < 80)"""

LEXED = f"""{LINES},
kinds AS (
  SELECT file_id, line_no, line, length(line) % 5 AS m,
         CASE WHEN length(line) % 5 <= 1 THEN ['COMMENT', 'NL'] WHEN length(line) % 5 = 2 THEN ['CODE', 'COMMENT', 'NEWLINE']
              WHEN length(line) % 5 = 3 THEN ['CODE', 'NEWLINE'] ELSE ['NL'] END AS types
  FROM line_rows),
typed AS (SELECT file_id, line_no, line, m, unnest(types) AS type, generate_subscripts(types, 1) AS j FROM kinds),
numbered AS (
  SELECT *, row_number() OVER w AS idx, lag(type) OVER w AS before FROM typed WINDOW w AS (PARTITION BY file_id ORDER BY line_no, j)),
comments AS (
  SELECT *, CASE WHEN idx - lag(idx) OVER w = 2 AND before = 'NL' THEN 0 ELSE 1 END AS fresh
  FROM numbered WHERE type = 'COMMENT' WINDOW w AS (PARTITION BY file_id ORDER BY idx)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY idx) - 1 AS block_no FROM comments),
firsts AS (SELECT *, row_number() OVER (PARTITION BY file_id, block_no ORDER BY idx) AS nth FROM grouped),
cleaned AS (SELECT *, trim(CASE WHEN nth = 1 THEN substr(line, m + 1) ELSE line END, '# ' || chr(10)) AS shown FROM firsts),
blocks AS (
  SELECT file_id, CAST(block_no AS INTEGER) AS block_no, CAST(min(line_no) - 1 AS INTEGER) AS srow, CAST(arg_min(m, idx) AS INTEGER) AS scol,
         CAST(max(line_no) - 1 AS INTEGER) AS erow, CAST(arg_max(length(line), idx) AS INTEGER) AS ecol,
         coalesce(string_agg(CASE WHEN shown <> '' THEN shown END, ' ' ORDER BY idx), '') AS text
  FROM cleaned GROUP BY file_id, block_no)"""

REPOS = """repos AS (
  SELECT 'https://code.example/' || string_split(string_split(url, '/')[3], '.')[1] || '/' || string_split(url, '/')[3] AS url,
         length(html) AS stars, page_id AS seq, url LIKE 'https:%' AS secure FROM pages)"""

PREDICTIONS = """scores AS (
  SELECT d.doc_id, source, text, quality, CAST(n_chars * 7 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
predictions AS (
  SELECT doc_id AS file_id, source AS repo, text, CAST(doc_id % 3 AS INTEGER) AS fold,
         CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
         CASE WHEN score >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted_label,
         CASE WHEN score >= 0.5 THEN score ELSE CAST(1 AS DOUBLE) - score END AS prob
  FROM scores)"""

SCORED = f"""{LINES},
scored AS (
  SELECT file_id, CAST(line_no - 1 AS INTEGER) AS block_no, CASE WHEN length(line) % 3 = 0 THEN 'positive' ELSE 'negative' END AS label,
         CAST(length(line) * 37 % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS prob
  FROM line_rows)"""

CONVERSATIONS = """turns AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
pairs AS (
  SELECT a.conv_id || '-' || a.turn AS pair_id, a.text AS hypothesis, b.text AS reference
  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)"""
