"""Lexing, comment blocks and comment cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from tarnmill.functions import text
from tarnmill.operators import comments, lexing

QUERIES, ORACLES, query = s.registry()


def _source_files(spark, sf):
    return s.files(spark, sf).select("file_id", "repo", "text")


@query("lexed_tokens")
def lexed_tokens(spark, sf):
    lexed = lexing.lex_files(_source_files(spark, sf))
    return lexed.select("file_id", "lex_error", F.inline_outer("tokens"))


@query("lex_status")
def lex_status(spark, sf):
    lexed = lexing.lex_files(_source_files(spark, sf))
    failed = comments.lex_failures(lexed, "file_id").select("file_id", F.lit(0).alias("num_tokens"), "lex_error")
    passed = lexed.where(F.col("lex_error").isNull()).select("file_id", F.size("tokens").alias("num_tokens"), "lex_error")
    return passed.unionByName(failed)


@query("code_token_lines")
def code_token_lines(spark, sf):
    lexed = comments.filter_blocks(comments.comment_blocks(lexing.lex_files(_source_files(spark, sf))))
    coded = lexing.code_lines(lexed)
    return coded.select("file_id", F.size("code").alias("num_lines"), "code_error", F.md5(F.to_json("code")).alias("digest"))


@query(
    "restored_source",
    f"""WITH {s.CODE}, shown AS (
      SELECT file_id, line_no, array_to_string(CASE WHEN is_comment THEN ['#'] || toks[2:-2] ELSE toks END, ' ') AS line FROM code WHERE len(toks) > 0)
    SELECT f.file_id, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS source FROM files f LEFT JOIN shown s ON f.file_id = s.file_id GROUP BY f.file_id""",
)
def restored_source(spark, sf):
    lines = s.code_lines(spark, sf)
    return lines.select("file_id", lexing.untokenize(F.col("lines")).alias("source"))


def _blocks(spark, sf):
    return comments.comment_blocks(s.lexed(spark, sf))


@query("comment_blocks", f"WITH {s.LEXED} SELECT file_id, block_no, srow, scol, erow, ecol FROM blocks")
def comment_blocks(spark, sf):
    rows = comments.comment_rows(_blocks(spark, sf), "file_id")
    return rows.select("file_id", "block_no", "srow", "scol", "erow", "ecol")


@query("comment_texts", f"WITH {s.LEXED} SELECT file_id, block_no, text FROM blocks")
def comment_texts(spark, sf):
    return comments.comment_rows(_blocks(spark, sf), "file_id").select("file_id", "block_no", "text")


@query("block_lines_by_position", f"WITH {s.LEXED} SELECT b.file_id, block_no, string_agg(line, chr(10) ORDER BY line_no) AS lines FROM blocks b JOIN line_rows r ON b.file_id = r.file_id AND r.line_no - 1 BETWEEN srow AND erow GROUP BY b.file_id, block_no")
def block_lines_by_position(spark, sf):
    files = _blocks(spark, sf)
    taken = F.transform(
        "blocks", lambda b: F.struct(b["block_no"].alias("block_no"), text.comment_lines(F.col("lines"), b["srow"], b["erow"]).alias("lines"))
    )
    rows = files.select("file_id", F.inline(taken))
    return rows.select("file_id", "block_no", F.array_join("lines", "\n").alias("lines"))


@query(
    "file_comment_positions",
    f"""WITH {s.LEXED} SELECT file_id, CAST(count(*) AS INTEGER) AS num_comments,
    string_agg(srow || ',' || scol || ',' || erow || ',' || ecol, ';' ORDER BY block_no) AS positions FROM blocks GROUP BY file_id""",
)
def file_comment_positions(spark, sf):
    found = comments.file_comments(_blocks(spark, sf))
    written = F.transform("positions", lambda p: F.concat_ws(",", *[p[c].cast("string") for c in ("srow", "scol", "erow", "ecol")]))
    return found.select("file_id", "num_comments", F.array_join(written, ";").alias("positions"))


@query("commented_files", f"WITH {s.LEXED} SELECT file_id, count(*) AS num_comments FROM blocks GROUP BY file_id HAVING count(*) > 0")
def commented_files(spark, sf):
    found = comments.file_comments(_blocks(spark, sf))
    return found.where(F.col("num_comments") > 0).select("file_id", F.col("num_comments").cast("bigint").alias("num_comments"))


@query("filtered_comments", f"WITH {s.LEXED} SELECT file_id, block_no FROM blocks WHERE length(text) > 40")
def filtered_comments(spark, sf):
    kept = comments.filter_blocks(_blocks(spark, sf), lambda b: F.length(b["text"]) > 40)
    return comments.comment_rows(kept, "file_id").select("file_id", "block_no")


@query("default_filtered_comments")
def default_filtered_comments(spark, sf):
    kept = comments.filter_blocks(_blocks(spark, sf))
    return comments.comment_rows(kept, "file_id").select("file_id", "block_no", "text")


# The word-splitting rules one by one, as the SQL applies them.
_RULES = [
    (r"([«“‘„»”’])", r" \1 "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (r"([?!])", r" \1 "),
    (r"([*])", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", r" -- "),
    (r"\b(can)(not)\b", r" \1 \2 "),
    (r"\b(gim)(me)\b", r" \1 \2 "),
    (r"\b(gon)(na)\b", r" \1 \2 "),
    (r"\b(got)(ta)\b", r" \1 \2 "),
    (r"\b(lem)(me)\b", r" \1 \2 "),
    (r"\b(wan)(na)\b", r" \1 \2 "),
]


def _cleaned_sql(deleted: str, shown: str) -> str:
    spaced = f"translate(lower(text), $q${deleted}$q$, '')"
    for pattern, replacement in _RULES:
        spaced = f"regexp_replace({spaced}, $q${pattern}$q$, '{replacement}', 'g')"
    return f"SELECT doc_id AS file_id, array_to_string(list_filter(regexp_split_to_array({spaced}, '\\s+'), lambda w: w <> ''), ' ') AS {shown} FROM documents"


@query("cleaned_for_classifier", _cleaned_sql(text.CLASSIFIER_DELETED, "cleaned"))
def cleaned_for_classifier(spark, sf):
    return _source_files(spark, sf).select("file_id", text.clean_comment(F.col("text")).alias("cleaned"))


@query("cleaned_for_vectors", _cleaned_sql(text.VECTOR_DELETED, "cleaned"))
def cleaned_for_vectors(spark, sf):
    return _source_files(spark, sf).select("file_id", text.clean_comment(F.col("text"), text.VECTOR_DELETED).alias("cleaned"))


@query(
    "words_per_comment",
    _cleaned_sql("", "cleaned").replace("SELECT doc_id", "SELECT file_id, CAST(len(string_split(cleaned, ' ')) AS INTEGER) AS words FROM (SELECT doc_id").replace("FROM documents", "FROM documents) t"),
)
def words_per_comment(spark, sf):
    return _source_files(spark, sf).select("file_id", F.size(text.treebank_words(F.lower("text"))).alias("words"))
