"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths find the n-grams that a text holds more
than once; the rule measures the share of the text's characters inside them and inside
repeated lines. All windows of a chunk of rows are hashed and sorted at once in numpy.

Words are runs of code points outside space and U+0009 to U+000D. A text is rejected by
the base rule (fewer than 20 words, or over 30 % of its words in 8-word windows found
twice or more), or if repeated n-grams or lines cover more than their limit in LIMITS.

Null texts count as empty. Empty texts have no words and fail the base rule. Rows are
judged one by one, so repeated rows and ids, and null ids, each keep a row of their own.
Other columns are not read, whatever their names. Very long texts are handled whole; memory
grows with the longest single text. Two different windows count as equal only if their
64-bit hashes and the 64-bit hashes of all their words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import NOT_SPACE, U64, bytes_of, chunks, mixed, powers, span_hashes, window_hashes, word_bounds

MIN_WORDS = 20
BASE_WIDTH = 8
BASE_PERCENT = 30
# n-gram length: most percent of the words' characters that repeated n-grams may cover
LIMITS = {5: 40, 8: 30, 12: 25}
# most percent of the words' characters in lines equal to an earlier line
LINE_LIMIT = 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in LIMITS)]


def repeated_windows(words: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Flags of the windows (by first word) that occur twice or more in their row."""
    n = len(words) - width + 1
    flags = np.zeros(max(n, 0), bool)
    if n <= 0:
        return flags
    starts = np.flatnonzero(rows[:n] == rows[width - 1 :])
    keys = (window_hashes(words, width)[starts]) ^ mixed(rows[starts].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    first, second = starts[order[same]], starts[order[same + 1]]
    # equal hashes are confirmed word by word, within one row
    equal = rows[first] == rows[second]
    for k in range(width):
        equal &= words[first + k] == words[second + k]
    flags[first[equal]] = True
    flags[second[equal]] = True
    return flags


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words that lie in at least one flagged window."""
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change[:-1]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every row of a text column."""
    data, bounds = bytes_of(column)
    n_rows = len(column)
    starts, stops, rows = word_bounds(data, bounds, NOT_SPACE)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[stops] - points[starts]
    words = span_hashes(data, starts, stops)

    def per_row(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n_rows).astype(np.int64)

    out = {
        "n_words": np.bincount(rows, minlength=n_rows).astype(np.int64),
        "word_chars": per_row(chars, rows),
    }
    symbols = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = np.bincount(np.searchsorted(bounds, symbols, side="right") - 1, minlength=n_rows).astype(np.int64)

    # a line is its bytes between line feeds; only lines with a word count
    feeds = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([bounds[:-1], feeds + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_stops = np.append(line_starts[1:], len(data))
    line_rows = np.searchsorted(bounds, line_starts, side="right") - 1
    line_stops = np.where((line_stops > line_starts) & (data[np.maximum(line_stops - 1, 0)] == 10), line_stops - 1, line_stops) if len(data) else line_stops
    in_line = np.searchsorted(line_starts, starts, side="right") - 1
    line_chars = np.bincount(in_line, weights=chars, minlength=len(line_starts)).astype(np.int64) if len(line_starts) else np.zeros(0, np.int64)
    worded = np.flatnonzero(line_chars > 0)
    keys = span_hashes(data, line_starts[worded], line_stops[worded]) ^ mixed(line_rows[worded].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    again = worded[order[1:][keys[order[1:]] == keys[order[:-1]]]]
    out["n_dup_lines"] = np.bincount(line_rows[again], minlength=n_rows).astype(np.int64)
    out["dup_line_chars"] = per_row(line_chars[again], line_rows[again])

    found = covered(repeated_windows(words, rows, BASE_WIDTH), BASE_WIDTH, len(words))
    out["n_repeat_words"] = np.bincount(rows[found], minlength=n_rows).astype(np.int64)
    for width in LIMITS:
        mask = found if width == BASE_WIDTH else covered(repeated_windows(words, rows, width), width, len(words))
        out[f"dup_{width}gram_chars"] = per_row(chars[mask], rows[mask])
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the measures."""
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    over = 100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    for width, limit in LIMITS.items():
        over |= 100 * m[f"dup_{width}gram_chars"] > limit * m["word_chars"]
    return base_failed, ~(base_failed | over)


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the measures, ``base_failed`` and ``kept``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            m = measure(part.column("text"))
            base_failed, kept = verdict(m)
            columns = [part.column("doc_id"), *(pa.array(m[name]) for name in MEASURES), pa.array(base_failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *MEASURES, "base_failed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *(f"{name} bigint" for name in MEASURES), "base_failed boolean", "kept boolean"])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the rules."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            _, kept = verdict(measure(part.column("text")))
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
