"""Comment text: block text, cleaning and word splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends of a comment line.
COMMENT_EDGE = "#\n "

# Characters deleted before word splitting, for the classifier and for
# the word-vector corpus. One set should serve both; the second is kept for parity.
CLASSIFIER_DELETED = ".()[]`\"'"
VECTOR_DELETED = ".-()[]`\"'#"

# The published Treebank word-splitting rules that can still match once
# periods, quotes and brackets are gone: characters that are words of their own, and
# contractions that split in two.
SINGLE_CHARS = "«“‘„»”’;@#$%&?!*][(){}<>"
CONTRACTIONS = ["can not", "gim me", "gon na", "got ta", "lem me", "wan na"]


def comment_lines(lines: Column, srow: Column, erow: Column) -> Column:
    """The source lines a block covers; rows are zero-based."""
    return F.slice(lines, srow + 1, erow - srow + 1)


def block_text(lines: Column, scol: Column) -> Column:
    """One line of text for a comment block: the first line is cut at its start
    column, edges are stripped, empty lines dropped, the rest joined by spaces."""
    first = F.array(F.substr(F.element_at(lines, 1), scol + 1))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    stripped = F.transform(F.concat(first, rest), lambda line: F.btrim(line, F.lit(COMMENT_EDGE)))
    return F.array_join(F.filter(stripped, lambda line: line != ""), " ")


def delete_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def treebank_words(text: Column) -> Column:
    """Split into words by the Treebank rules (for text already freed of periods,
    quotes and brackets, where sentence boundaries no longer matter). Colons and commas
    stay inside numbers, double dashes are words."""
    singles = "[" + "".join("\\" + c for c in SINGLE_CHARS) + "]"
    halves = [pair.split(" ") for pair in CONTRACTIONS]
    first_half = "|".join(rf"{a}(?={b}\b)" for a, b in halves)
    spaced = F.regexp_replace(text, f"({singles})", " $1 ")
    spaced = F.regexp_replace(spaced, r"([:,])([^0-9])|([:,])$", " $1$3 $2")
    spaced = F.regexp_replace(spaced, "--", " -- ")
    spaced = F.regexp_replace(spaced, rf"\b({first_half})", "$1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda word: word != "")


def clean_comment(text: Column, deleted: str = CLASSIFIER_DELETED) -> Column:
    """Lower-case, delete punctuation, split into words, join by spaces."""
    return F.array_join(treebank_words(delete_chars(F.lower(text), deleted)), " ")
