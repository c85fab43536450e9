"""Python source files to lexical tokens and to lines of code tokens."""

from __future__ import annotations

import io
import tokenize
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarnmill.functions.tasks import ROWS_AT_ONCE, row_function
from tarnmill.markers import BEGIN_COMMENT, DEDENT, END_COMMENT, INDENT, NEWLINE

LEX_ERRORS = (tokenize.TokenError, SyntaxError, ValueError)

_TOKEN_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "text")] + [T.StructField(n, T.IntegerType()) for n in ("srow", "scol", "erow", "ecol")]
)
_LEX_TYPE = T.StructType([T.StructField("tokens", T.ArrayType(_TOKEN_TYPE)), T.StructField("error", T.StringType())])
# tokens taken from the lexer at once, and files whose tokens become lines at once
TOKENS_AT_ONCE = 512
LEXED_AT_ONCE = 512
_CODE_TYPE = T.StructType(
    [
        T.StructField("lines", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("error", T.StringType()),
    ]
)
_KINDS = pa.array([tokenize.tok_name.get(k, "") for k in range(max(tokenize.tok_name) + 1)])


def _lex_batch(texts: list[str | None]) -> pa.StructArray:
    """Tokens of some files; a file with an error has the error and no tokens."""
    kinds, strings, starts, ends, sizes, errors = [], [], [], [], [], []
    for text in texts:
        before, parts, error = len(kinds), len(starts), None
        found = tokenize.generate_tokens(io.StringIO(text or "").readline)
        try:
            # few tokens are held as objects, so the collector has few to look at
            while some := list(islice(found, TOKENS_AT_ONCE)):
                kind, string, start, end, _ = zip(*some)
                kinds += kind
                strings += string
                starts.append(np.fromiter(chain.from_iterable(start), np.int32, 2 * len(some)))
                ends.append(np.fromiter(chain.from_iterable(end), np.int32, 2 * len(some)))
        except LEX_ERRORS as raised:
            error = type(raised).__name__
            del kinds[before:], strings[before:], starts[parts:], ends[parts:]
        sizes.append(len(kinds) - before)
        errors.append(error)
    points = (np.concatenate([np.zeros(0, np.int32), *some]).reshape(-1, 2) for some in (starts, ends))
    numbers = [pa.array(np.ascontiguousarray(some[:, k])) for some in points for k in (0, 1)]
    columns = [_KINDS.take(pa.array(kinds, pa.int32())), pa.array(strings, pa.string()), *numbers]
    tokens = pa.StructArray.from_arrays(columns, fields=list(to_arrow_type(_TOKEN_TYPE)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), tokens)
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], names=["tokens", "error"])


def _lex(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                yield _lex_batch(batch.slice(start, ROWS_AT_ONCE).to_pylist())

    return F.arrow_udf(run, _LEX_TYPE).asNondeterministic()(text)


def lex_files(files: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lines``, ``tokens`` (rows counted from 1, as the lexer does) and ``lex_error``.

    Each file is lexed inside its row. A file the lexer rejects keeps its row with the
    error class and an empty token array.
    """
    lexed = files.withColumn("__lexed", _lex(F.col(text)))
    return lexed.withColumns(
        {"lines": F.split(text, "\n"), "tokens": F.col("__lexed.tokens"), "lex_error": F.col("__lexed.error")}
    ).drop("__lexed")


def _code_lines(text: str, notes: dict[int, str], strip_docstrings: bool) -> list[list[str]]:
    """Code tokens per logical line, with comment lines ahead of the line they meet."""
    source = text.split("\n")
    done: list[list[str]] = []
    shifts: list[str] = []
    line: list[str] = []
    kinds: set[int] = set()
    opened: list[tuple[int, int]] = []
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        name = tokenize.tok_name[token.type]
        if name == "COMMENT":
            words = notes.get(token.start[0] - 1, "").split()
            if words:
                done.append([BEGIN_COMMENT, *words, END_COMMENT])
        elif name in ("INDENT", "DEDENT"):
            shifts.append(INDENT if name == "INDENT" else DEDENT)
        elif name == "NEWLINE":
            if not (strip_docstrings and kinds == {tokenize.STRING}):
                done.append(shifts + line)
                shifts = []
            line, kinds = [], set()
        elif name.endswith("STRING_START"):
            opened.append(token.start)
        elif opened and not name.endswith("STRING_END"):
            continue
        elif name not in ("NL", "ENDMARKER"):
            written = token.string
            if opened:
                start = opened.pop()
                if opened:
                    continue
                written = _source_between(source, start, token.end)
            kinds.add(token.type)
            line += written.replace("\n", f" {NEWLINE} ").split()
    if line or shifts:
        done.append(shifts + line)
    return done


def _source_between(source: list[str], start: tuple[int, int], end: tuple[int, int]) -> str:
    rows = source[start[0] - 1 : end[0]]
    rows[-1] = rows[-1][: end[1]]
    rows[0] = rows[0][start[1] :]
    return "\n".join(rows)


def _code_record(text, rows, comments, strip_docstrings: bool) -> dict:
    try:
        notes = dict(zip(rows or [], comments or []))
        return {"lines": _code_lines(text or "", notes, strip_docstrings), "error": None}
    except LEX_ERRORS as error:
        return {"lines": [], "error": type(error).__name__}


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flattened values; a null list is empty."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each has."""
    parts = pc.utf8_split_whitespace(texts)
    words, bounds = parts.flatten(), _bounds(parts)
    filled = pc.not_equal(words, "")
    return words.filter(filled), np.diff(np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))[bounds])


def _line_batch(types: pa.Array, texts: pa.Array, srows: pa.Array, rows: pa.Array, comments: pa.Array, strip_docstrings: bool) -> pa.ListArray:
    """What ``_code_lines`` makes, from the tokens of many files at once; f-strings are not put together.

    A line is known by twice the number of the token that ends it: its comment or its NEWLINE.
    """
    bounds = _bounds(types)
    name, text, srow = (column.flatten() for column in (types, texts, srows))
    file = np.repeat(np.arange(len(types)), np.diff(bounds))
    at = {kind: np.flatnonzero(pc.equal(name, kind).to_numpy(zero_copy_only=False)) for kind in ("COMMENT", "INDENT", "DEDENT", "NEWLINE", "STRING")}
    shift = np.sort(np.append(at["INDENT"], at["DEDENT"]))
    plain = pc.invert(pc.is_in(name, pa.array(["COMMENT", "INDENT", "DEDENT", "NEWLINE", "NL", "ENDMARKER"])))
    word = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
    newline = at["NEWLINE"]
    if strip_docstrings:
        # lines of strings only go; what shifts them stays for the next line. A line that its file ends stays
        def ended(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.searchsorted(newline, token)
            return by, np.append(file[newline], -1)[by] == file[token]

        (by, own), (strung, inside) = ended(word), ended(at["STRING"])
        held, strings = np.bincount(by[own], minlength=len(newline) + 1), np.bincount(strung[inside], minlength=len(newline) + 1)
        gone = (held > 0) & (held == strings)
        word = word[~(gone[by] & own)]
        newline = newline[~gone[:-1]]

    def line_of(token: np.ndarray) -> np.ndarray:
        following = np.append(newline, 2 * len(file))[np.searchsorted(newline, token)]
        return np.minimum(2 * following, 2 * bounds[1:][file[token]] - 1)

    # comments that are kept, by file and row; of equal rows the last counts
    owner = np.repeat(np.arange(len(rows)), np.diff(_bounds(rows)))
    note = (owner << 32) + rows.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(note, kind="stable")
    here = at["COMMENT"]
    wanted = (file[here] << 32) + srow.to_numpy(zero_copy_only=False)[here] - 1
    found = np.searchsorted(note[order], wanted, side="right") - 1
    hit = (found >= 0) & (np.append(note[order], -1)[found] == wanted)
    here, found = here[hit], order[found[hit]]
    noted, sizes = _split(comments.flatten().take(pa.array(found)))
    here, sizes = here[sizes > 0], sizes[sizes > 0]

    written, counts = _split(pc.replace_substring(text.take(pa.array(word)), "\n", f" {NEWLINE} "))
    marks = [pa.array(["INDENT", "DEDENT"]), pa.array([INDENT, DEDENT])]
    shifts = marks[1].take(pc.index_in(name.take(pa.array(shift)), marks[0]))
    first, last = (pa.array([mark] * len(here), pa.string()) for mark in (BEGIN_COMMENT, END_COMMENT))
    pieces = pa.concat_arrays([shifts, written, first, noted, last])
    line = np.concatenate([line_of(shift), np.repeat(line_of(word), counts), 2 * here, np.repeat(2 * here, sizes), 2 * here])
    order = np.argsort(line, kind="stable")
    lines = np.unique(np.concatenate([2 * newline, line]))
    inner = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(line[order], lines), len(line)), pa.int32()), pieces.take(pa.array(order)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(lines, 2 * bounds), pa.int32()), inner)


def _lexed_lines(strip_docstrings: bool):
    """Arrow function from text, token columns, error and comments to lines of code tokens."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch[0]), LEXED_AT_ONCE):
                text, types, texts, srows, errors, rows, comments = (column.slice(start, LEXED_AT_ONCE) for column in batch)
                lines = _line_batch(types, texts, srows, rows, comments, strip_docstrings)
                # a string made of several tokens is taken from the source
                opened = np.flatnonzero(pc.ends_with(types.flatten(), "STRING_START").to_numpy(zero_copy_only=False))
                number, parts = np.arange(len(text)), [lines]
                for n, k in enumerate(np.unique(np.searchsorted(_bounds(types), opened, side="right") - 1).tolist()):
                    record = _code_record(text[k].as_py(), rows[k].as_py(), comments[k].as_py(), strip_docstrings)
                    parts.append(pa.array([record["lines"]], lines.type))
                    number[k] = len(text) + n
                yield pa.StructArray.from_arrays([pa.concat_arrays(parts).take(pa.array(number)), errors], names=["lines", "error"])

    return F.arrow_udf(run, _CODE_TYPE).asNondeterministic()


def code_lines(files: DataFrame, text: str = "text", strip_docstrings: bool = False) -> DataFrame:
    """Add ``code`` (lines of code tokens) and ``code_error``.

    ``blocks``, if the table has it, names the comments to keep; without it no comment
    is kept. A comment becomes a line of its own, ahead of the logical line in which it
    starts. Line breaks inside a string literal become a marker. A table with the ``tokens``
    and ``lex_error`` of ``lex_files`` is not lexed again.
    """
    if "blocks" in files.columns:
        rows, words = F.col("blocks.srow"), F.col("blocks.text")
    else:
        rows = F.array().cast("array<int>")
        words = F.array().cast("array<string>")
    if {"tokens", "lex_error"} <= set(files.columns):
        tokens = [F.col(f"tokens.{name}") for name in ("type", "text", "srow")]
        made = _lexed_lines(strip_docstrings)(F.col(text), *tokens, F.col("lex_error"), rows, words)
    else:
        made = row_function(_CODE_TYPE, lambda: partial(_code_record, strip_docstrings=strip_docstrings))(F.col(text), rows, words)
    built = files.withColumn("__code", made)
    return built.withColumns({"code": F.col("__code.lines"), "code_error": F.col("__code.error")}).drop("__code")


def _untokenize(lines: list[list[str]]) -> str:
    depth, out = 0, []
    for line in lines:
        shift = line.count(INDENT) - line.count(DEDENT)
        words = [word for word in line if word not in (INDENT, DEDENT)]
        depth = max(0, depth + shift)
        if not words:
            continue
        if words[0] == BEGIN_COMMENT:
            words = ["#", *words[1 : -1 if words[-1] == END_COMMENT else None]]
        out.append("    " * depth + " ".join(words).replace(f" {NEWLINE} ", "\n").replace(NEWLINE, "\n"))
    return "\n".join(out)


_untokenize_rows = row_function(
    T.StringType(), lambda: lambda lines: None if lines is None else _untokenize(lines)
)


def untokenize(lines: Column) -> Column:
    """Source text from lines of code tokens: the inverse of ``code_lines`` up to spacing."""
    return _untokenize_rows(lines)
