"""Comment blocks of lexed files."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.arrays import let, where_index
from tarnmill.functions.tasks import row_function
from tarnmill.functions.text import block_text


def block_spans(tokens: Column) -> Column:
    """Array of blocks ``block_no, srow, scol, erow, ecol, rows`` with zero-based rows.

    A comment continues the block of the previous comment if it follows directly or
    with a single NL token between; anything else starts a new block. The rule only
    looks at neighbouring tokens, so it is computed inside the row.
    """
    return let(tokens, _spans_of)


def _spans_of(tokens: Column) -> Column:
    def starts_block(at: Column, j: Column, comments: Column) -> Column:
        previous = F.get(comments, j - 1)
        one_break = (at - previous == 2) & (F.get(tokens, at - 1)["type"] == "NL")
        return (j == 0) | ~((at - previous == 1) | one_break)

    def spans(found: Column) -> Column:
        comments, starts = found["comments"], found["starts"]

        def span(start: Column, number: Column) -> Column:
            end = F.coalesce(F.get(starts, number + 1), F.size(comments))
            members = F.transform(F.slice(comments, start + 1, end - start), lambda i: F.get(tokens, i))
            return let(
                members,
                lambda m: F.struct(
                    number.alias("block_no"),
                    (F.get(m, F.lit(0))["srow"] - 1).alias("srow"),
                    F.get(m, F.lit(0))["scol"].alias("scol"),
                    (F.element_at(m, -1)["erow"] - 1).alias("erow"),
                    F.element_at(m, -1)["ecol"].alias("ecol"),
                    F.transform(m, lambda t: t["srow"] - 1).alias("rows"),
                ),
            )

        return F.transform(starts, span)

    def with_starts(comments: Column) -> Column:
        marked = F.transform(comments, lambda at, j: F.when(starts_block(at, j, comments), j))
        return F.struct(comments.alias("comments"), F.filter(marked, lambda j: j.isNotNull()).alias("starts"))

    return let(
        where_index(tokens, lambda t: t["type"] == "COMMENT"),
        lambda comments: let(with_starts(comments), spans),
    )


def comment_blocks(files: DataFrame) -> DataFrame:
    """Add ``blocks``: span, source ``lines`` and cleaned ``text`` of every comment block.

    Needs ``lines`` and ``tokens`` as ``lex_files`` makes them.
    """

    def block(span: Column, lines: Column) -> Column:
        return F.struct(
            *[span[name].alias(name) for name in ("block_no", "srow", "scol", "erow", "ecol")],
            lines.alias("lines"),
            block_text(lines, span["scol"]).alias("text"),
        )

    def blocks(source: Column) -> Column:
        return F.transform(
            block_spans(source["tokens"]),
            lambda span: let(
                F.transform(span["rows"], lambda row: F.get(source["lines"], row)),
                lambda lines: block(span, lines),
            ),
        )

    return files.withColumn("blocks", let(F.struct("lines", "tokens"), blocks))


def _is_code(line: str) -> bool:
    """Whether a comment line, freed of its marker, is a Python statement other than
    plain words, constants or arithmetic on them."""
    stripped = line.strip().lstrip("#").strip()
    if not stripped:
        return True
    try:
        parsed = ast.parse(stripped + " pass" if stripped.endswith(":") else stripped).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    prose = (ast.Name, ast.Constant, ast.Tuple, ast.BinOp, ast.Attribute, ast.BoolOp, ast.Compare, ast.UnaryOp)
    return not any(
        (isinstance(node, ast.Expr) and isinstance(node.value, prose))
        or (isinstance(node, ast.AnnAssign) and node.value is None)
        for node in parsed
    )


def _code_flags(lines: list[list[str]] | None, columns: list[int] | None) -> list[bool]:
    """For each comment block, whether all its lines are code."""
    return [
        all(map(_is_code, [block[0][column:], *block[1:]]))
        for block, column in zip(lines or [], columns or [])
    ]


_all_code = row_function(T.ArrayType(T.BooleanType()), lambda: _code_flags)


def filter_blocks(files: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Keep the blocks for which ``keep`` (a predicate on the block struct) holds.

    By default empty comments and commented-out code are dropped.
    """
    if keep is not None:
        return files.withColumn("blocks", F.filter("blocks", keep))
    flagged = files.withColumn("__code", _all_code(F.col("blocks.lines"), F.col("blocks.scol")))
    judged = F.zip_with("blocks", "__code", lambda b, code: F.struct(b.alias("block"), code.alias("code")))
    kept = F.filter(judged, lambda j: (j["block"]["text"] != "") & ~j["code"])
    return flagged.withColumn("blocks", F.transform(kept, lambda j: j["block"])).drop("__code")


def file_comments(files: DataFrame) -> DataFrame:
    """Replace ``blocks`` by ``num_comments`` and ``positions``; files without comments go."""
    positions = F.transform(
        "blocks", lambda b: F.struct(*[b[name].alias(name) for name in ("srow", "scol", "erow", "ecol")])
    )
    found = files.where(F.size("blocks") > 0)
    return found.withColumns({"num_comments": F.size("blocks"), "positions": positions}).drop("blocks")


def comment_rows(files: DataFrame, *keep: str) -> DataFrame:
    """One row per comment block: the kept file columns and the block's fields.

    The outer form keeps the optimizer from adding a filter on the array, which would
    compute the blocks a second time.
    """
    return files.select(*keep, F.inline_outer("blocks")).where(F.col("block_no").isNotNull())


def lex_failures(files: DataFrame, *keep: str) -> DataFrame:
    """Files the lexer rejected, with the error class."""
    return files.where(F.col("lex_error").isNotNull()).select(*keep, "lex_error")
