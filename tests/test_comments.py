"""Lexer, comment blocks and cleaning against hand-written sources."""

import io
import random
import tokenize

import pytest
from pyspark.sql import functions as F

from tarnmill.functions.text import VECTOR_DELETED, clean_comment
from tarnmill.operators import comments, lexing

SOURCES = {
    "merge": ("x = 1 # a\n# b\n  # c\n\n# d\ny=2\n", [(0, 6, 0, "a"), (1, 0, 2, "b c"), (4, 0, 4, "d")]),
    "brackets": ("f(a, # t1\n  # t2\n  b)\n", [(0, 5, 1, "t1 t2")]),
    "indents": ("if x:\n    y\n  # odd\n# e\nz\n", [(2, 2, 3, "odd e")]),
    "no_newline": ("# last", [(0, 0, 0, "last")]),
    "empty": ("#\n# \n", [(0, 0, 1, "")]),
    "error": ("x = (\n", []),
    "tabs": ("#\tkept tab\t\n", [(0, 0, 0, "\tkept tab\t")]),
}


def lexed(spark, sources):
    rows = spark.createDataFrame(list(sources.items()), "file_id string, text string")
    return comments.comment_blocks(lexing.lex_files(rows))


def test_blocks_of_known_sources(spark):
    found = {r["file_id"]: r for r in lexed(spark, {k: v[0] for k, v in SOURCES.items()}).collect()}
    for name, (_, expected) in SOURCES.items():
        got = [(b["srow"], b["scol"], b["erow"], b["text"]) for b in found[name]["blocks"]]
        assert got == expected, name
    assert found["error"]["lex_error"] == "TokenError"
    assert found["merge"]["lex_error"] is None


def naive_blocks(text):
    """Straight reading of the rule: one running block over the token stream."""
    blocks, current, gap = [], None, 0
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        kind = tokenize.tok_name[token.type]
        if kind == "COMMENT":
            if current is None:
                current = [token.start, token.end]
                blocks.append(current)
            current[1] = token.end
            gap = 0
        elif kind == "NL" and gap == 0:
            gap = 1
        else:
            current, gap = None, 0
    return [(a[0] - 1, a[1], b[0] - 1, b[1]) for a, b in blocks]


def test_blocks_of_random_sources(spark):
    rng = random.Random(4)
    pieces = ["# one\n", "  # two\n", "\n", "x = 1\n", "y = 2  # tail\n", "f(1, # in\n  2)\n", "#\n", "z(\n# a\n# b\n\n# c\n)\n"]
    sources = {str(i): "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for i in range(300)}
    for row in lexed(spark, sources).select("file_id", "blocks").collect():
        got = [(b["srow"], b["scol"], b["erow"], b["ecol"]) for b in row["blocks"]]
        assert got == naive_blocks(sources[row["file_id"]])


def test_default_filter_drops_empty_and_code(spark):
    sources = {"a": "# x = compute(1)\n\n# explains it\n\n#\n\n# for i in y:\n\n# return value\n\n# note: mind this\n"}
    kept = comments.filter_blocks(lexed(spark, sources))
    texts = [r["text"] for r in comments.comment_rows(kept, "file_id").collect()]
    assert texts == ["explains it", "note: mind this"]


def test_file_comments_and_failures(spark):
    files = lexed(spark, {k: v[0] for k, v in SOURCES.items()})
    found = {r["file_id"]: r for r in comments.file_comments(files).collect()}
    assert "error" not in found
    assert found["merge"]["num_comments"] == 3
    assert tuple(found["merge"]["positions"][1]) == (1, 0, 2, 5)
    assert [r["file_id"] for r in comments.lex_failures(files, "file_id").collect()] == ["error"]


CODE = 'import os\n\n\ndef f(a, b):\n    """Doc\n    string."""\n    # adds both\n    if a:\n        return f"v {a!r:>{b}} x"\n    return a + b  # the sum\n\n\nprint(f(1, 2))\n'


def test_code_lines_and_back(spark):
    files = comments.filter_blocks(lexed(spark, {"a": CODE}))
    coded = lexing.code_lines(files).withColumn("source", lexing.untokenize(F.col("code"))).first()
    lines = coded["code"]
    assert ["<COMMENT>", "adds", "both", "</COMMENT>"] in lines
    at = lines.index(["<COMMENT>", "the", "sum", "</COMMENT>"])
    assert lines[at + 1][-4:] == ["return", "a", "+", "b"]
    assert lines[-1][0] == "<DEDENT>"

    def kinds(text):
        skip = ("NL", "COMMENT", "INDENT", "DEDENT", "ENDMARKER", "NEWLINE")
        tokens = tokenize.generate_tokens(io.StringIO(text).readline)
        return ["".join(t.string.split()) for t in tokens if tokenize.tok_name[t.type] not in skip]

    assert kinds(coded["source"]) == kinds(CODE)
    compile(coded["source"], "restored", "exec")


def test_docstrings_can_be_stripped(spark):
    files = comments.filter_blocks(lexed(spark, {"a": CODE}))
    flat = [w for line in lexing.code_lines(files, strip_docstrings=True).first()["code"] for w in line]
    assert '"""Doc' not in flat
    assert flat.count("<INDENT>") == flat.count("<DEDENT>") == 2


def many_sources():
    rng = random.Random(5)
    pieces = ["# one\n", "  # two\n", "\n", "x = 1\n", "y = 2  # tail\n", "f(1, # in\n  2)\n", "#\n", "z(\n# a\n# b\n\n# c\n)\n", "if a:\n  b\n"]
    pieces += ["if a:\n\tif b:\n\t\tc # d\n", '"""doc\nstring"""\n', "'s'\n", "def f():\n    'doc'\n    # c\n    x\n", 'f"a{b}c {d!r:>{e}}"\n', "x = (\n", "last", "$\n"]
    pieces += ["a = \'\'\'q\n\n w\'\'\'; b\n", "\\\n", "p\x0cq\n", "é = 'ü\u00a0ö'\n", "class A:\n  'd'\n", "'a' 'b' # t\n", "\u2003x\n", "pass;"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    return [(str(i), text) for i, text in enumerate([*texts, None, ""])]


@pytest.mark.parametrize("strip", [False, True])
def test_code_lines_are_those_of_a_second_lexing(spark, strip):
    rows = spark.createDataFrame(many_sources(), "file_id string, text string")
    files = comments.filter_blocks(comments.comment_blocks(lexing.lex_files(rows)), lambda b: b["text"] != "")
    got = lexing.code_lines(files, strip_docstrings=strip).select("text", "blocks", "code", "code_error").collect()
    assert sum(r["code_error"] is not None for r in got) > 100
    for row in got:
        want = lexing._code_record(row["text"], [b["srow"] for b in row["blocks"]], [b["text"] for b in row["blocks"]], strip)
        assert (row["code"], row["code_error"]) == (want["lines"], want["error"]), row["text"]


def test_a_lexed_table_is_not_lexed_again(spark):
    files = comments.filter_blocks(lexed(spark, {"a": "import os\nx = 1\n"}))
    # code comes from the tokens, so a table that carries others shows them
    others = F.transform("tokens", lambda t: t.withField("text", F.when(t["text"] == "import", "fetch").otherwise(t["text"])))
    assert lexing.code_lines(files.withColumn("tokens", others)).first()["code"] == [["fetch", "os"], ["x", "=", "1"]]


@pytest.mark.parametrize("size", [1, 512])
def test_tokens_are_those_of_the_lexer(monkeypatch, size):
    monkeypatch.setattr(lexing, "TOKENS_AT_ONCE", size)
    texts = [text for _, text in many_sources()[-300:]]
    for text, row in zip(texts, lexing._lex_batch(texts).to_pylist()):
        try:
            want = [(tokenize.tok_name[t.type], t.string, *t.start, *t.end) for t in tokenize.generate_tokens(io.StringIO(text or "").readline)]
            assert ([tuple(t.values()) for t in row["tokens"]], row["error"]) == (want, None)
        except lexing.LEX_ERRORS as error:
            assert row == {"tokens": [], "error": type(error).__name__}


def test_code_lines_report_errors(spark):
    row = lexing.code_lines(spark.createDataFrame([("x = (\n",)], "text string")).first()
    assert row["code"] == [] and row["code_error"] == "TokenError"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Note: it can't (really) `fail`.", "note : it cant really fail"),
        ("a, b; c? cannot 1,000", "a , b ; c ? can not 1,000"),
        ("mix-in http/1.1 -- x", "mix-in http/11 -- x"),
        ("", ""),
    ],
)
def test_clean_comment(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(clean_comment(F.col("t"))).first()[0] == expected


def test_vector_cleaning_deletes_more(spark):
    df = spark.createDataFrame([("mix-in #1",)], "t string")
    assert df.select(clean_comment(F.col("t"), VECTOR_DELETED)).first()[0] == "mixin 1"
